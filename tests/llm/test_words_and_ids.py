"""Spelling variants, id planes and collocations against plain versions."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import catalog, collocations, planes, variants
from shelfwise.session import new_place
from tests.llm import cases, recall

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def awkward(spark):
    """The awkward rows several times, so that words and phrases are frequent."""
    odd = [(20 + i, f"Wörter wörter Worter, worten!? new york city\tnew york. ÀÉ {i}", None, "x", 1) for i in range(30)]
    odd += [(60 + i, "aaaaaaaa aaaaaaaab aaaaaaaac ; new york city , x", "en", "x", 1) for i in range(30)]
    return cases.documents(spark, [*cases.ROWS, *cases.ROWS, *odd])


# -- variants -------------------------------------------------------------------------


def plain_variants(rows):
    n=Counter()
    for doc_id,text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+",text or ""):
            run=run.translate(LOW); h=zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h%199==0: i=h%len(run); run=run[:i]+run[i+1:]
            if len(run)>=6: n[run]+=1
    n={w:c for w,c in n.items() if c>=5}
    near=defaultdict(set)
    by=defaultdict(set)
    for w in n:
        for i in range(len(w)): by[w[:i]+"*"+w[i+1:]].add(w)
        for i in range(len(w)):
            s=w[:i]+w[i+1:]
            if s in n: near[w].add(s); near[s].add(w)
    for g in by.values():
        for w in g: near[w]|=g-{w}
    form={}
    for w in n:
        if near[w]:
            b=min(near[w],key=lambda x:(-n[x],x))
            if n[b]>=5*n[w]: form[w]=b
    out=[]
    for w in n:
        r=w
        while r in form: r=form[r]
        out.append((w,form.get(w),r,n[w],len(near[w]),n[form[w]] if w in form else None))
    return out

@pytest.mark.parametrize("which", ["sf", "awkward", "empty"])
def test_variants(spark, tmp_path, which):
    docs = {"sf": lambda: spark.read.parquet(f"{FOLDER}/documents.parquet"), "awkward": lambda: awkward(spark)}
    docs = docs.get(which, lambda: cases.empty(spark))()
    folder = cases.saved(spark, tmp_path, documents=docs)
    got = [tuple(r) for r in catalog.queries()["op11_variants"](spark, folder).collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(plain_variants(rows), key=str)
    assert bool(got) == (which != "empty")


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(3, 8))
        prefix = [(int(r), int(p)) for r, p in zip(rng.integers(0, 9, n), rng.permutation(12)[:n], strict=True)]
        cost = rng.integers(1, 50, 9)
        pairs = [(a, b) for a in prefix for b in prefix if b[1] - a[1] >= variants.GRAM]
        if not pairs:
            continue
        best = min(int(cost[a[0]] + cost[b[0]]) for a, b in pairs)
        chosen = variants.pivots_of(prefix, cost)
        assert len(chosen) == 2 and sum(int(cost[r]) for r, _ in chosen) == best
        (_, x), (_, y) = chosen
        assert abs(x - y) >= variants.GRAM


def test_pairs_of_close_words(spark):
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abc"), size=n)) for n in rng.integers(6, 9, 700)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {(r["a"], r["b"]) for r in variants.near_pairs(df).collect()}

    def one_edit(w):
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        swap = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abc"}
        return (cut | swap | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abc"}) - {w}

    want = {(min(a, b), max(a, b)) for a in words for b in one_edit(a) & words}
    assert got == want and len(want) > 200


def test_roots_along_a_chain(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(20)], "word string, form string")
    assert {r["root"] for r in variants.roots_of(forms).collect()} == {"w20"}


# -- planes ---------------------------------------------------------------------------


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_encoder_is_the_library(monkeypatch):
    monkeypatch.setattr(planes, "SEGMENT", 100)
    rng = np.random.default_rng(1)
    letters = list("ab'st 1\n\n  .,é\t漢ÀZ \xa0 \r_×\0")
    texts = ["".join(rng.choice(letters, size=n)) for n in rng.integers(0, 60, 1500)]
    texts += ["", " ", "\n", "  a", "a  ", "x<|endoftext|> b", "a  <|endoftext|>  b", "don't 'sa 'S we'll  'll", "a \nb", "ab " * 900]
    with open(PATH, encoding="utf-8") as f:
        own = planes.PieceEncoder(f.read())
    monkeypatch.setattr(planes, "PIECES_KEPT", 50)  # pieces go and come again
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for ids, want in zip(own.encode(part), plain_ids(part), strict=True):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want[:-1]


@pytest.mark.parametrize("kind", ["bytes", "bits"])
def test_planes_turn_back(kind):
    rng = np.random.default_rng(2)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (planes.from_planes(planes.to_planes(ids, kind), n) == ids).all()


@pytest.mark.parametrize("which", ["awkward", "empty"])
def test_planes_query(spark, tmp_path, which):
    docs = awkward(spark) if which == "awkward" else cases.empty(spark)
    folder = cases.saved(spark, tmp_path, documents=docs)
    got = [tuple(r) for r in catalog.queries()["op12_planes"](spark, folder).collect()]
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    own = sorted(own, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    want, start = [], 0
    for r, ids in zip(own, plain_ids([r["text"] for r in own]), strict=True):
        want.append((r["doc_id"], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["bytes", "bits"])
def test_files_hold_any_span(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 60_000, n).astype("<u4") for n in (0, 1, 70_000, 5, 150_000, 0, 30)]
    rows = [(None if i == 0 else i, x.tobytes()) for i, x in enumerate(lists)]
    df = spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1)
    path = new_place(spark, "planes-test")
    for _ in range(2):  # the second replaces the first
        planes.write_ids(df, path, kind, file_ids=60_000)
    index = planes.index_of(path)
    flat = np.concatenate(lists)
    assert index["ids"] == len(flat) and len(index["files"]) > 2 and index["kind"] == kind
    for start, n in ((0, 10), (69_990, 100), (0, len(flat)), (220_000, 99), (len(flat), 5)):
        assert (planes.read_span(path, start, n) == flat[start : start + n]).all()
    back = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in planes.read_ids(spark, path).collect()}
    begins = np.cumsum([0, *map(len, lists)])
    assert back == {d: (int(b), x) for (d, x), b in zip(rows, begins, strict=False)}


def test_half_written_files_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(1, b"\1\0\0\0")], "doc_id long, ids binary")
    path = str(tmp_path / "p")
    planes.write_ids(df, path)
    (tmp_path / "p" / "part-00000-00000-lost.idp").write_bytes(b"IDPL")
    assert planes.read_ids(spark, path).count() == 1
    with pytest.raises(ValueError, match="complete"):
        planes.PlaneFile(*planes.place_of(f"{path}/{planes.INDEX}"))


# -- collocations ---------------------------------------------------------------------


def plain_collocations(rows, least=10, top=2000):
    f=defaultdict(Counter); n=Counter()
    low=str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ","abcdefghijklmnopqrstuvwxyz")
    for lang,text in rows:
        lang="und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]",(text or "").translate(low)):
            w=re.findall(r"[^\x20\x09]+",piece); n[lang]+=len(w)
            for k in (1,2,3):
                for i in range(len(w)-k+1): f[lang][tuple(w[i:i+k])]+=1
    out=[]
    for lang,cnt in f.items():
        cand={p:a for p,a in cnt.items() if len(p)>1 and a>=least}
        drop=set()
        for p,a in cand.items():
            if len(p)==3:
                for q in (p[:2],p[1:]):
                    if 100*a>=50*cnt[q]: drop.add(q)
        rows=[]
        for p,a in cand.items():
            if p in drop: continue
            s,k=min((1000000*a*a//(cnt[p[:k]]*cnt[p[k:]]),k) for k in range(1,len(p)))
            rows.append((-s,-a," ".join(p).encode(),cnt[p[:k]],cnt[p[k:]]))
        for r,(s,a,ph,l,rr) in enumerate(sorted(rows)[:top],1): out.append((lang,r,ph.decode(),-a,l,rr,n[lang],-s))
    return out

@pytest.mark.parametrize("which", ["sf", "awkward", "empty"])
def test_collocations(spark, tmp_path, which):
    docs = {"sf": lambda: spark.read.parquet(f"{FOLDER}/documents.parquet"), "awkward": lambda: awkward(spark)}
    docs = docs.get(which, lambda: cases.empty(spark))()
    folder = cases.saved(spark, tmp_path, documents=docs)
    got = [tuple(r) for r in catalog.queries()["op13_collocations"](spark, folder).collect()]
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    assert sorted(got) == sorted(plain_collocations(rows)) and bool(got) == (which != "empty")


def test_collocations_in_small_parts(spark, monkeypatch):
    """Hot prefixes in parts, small batches, a filter that lets much through: the same rows."""
    docs = awkward(spark)
    want = sorted(map(tuple, collocations.collocations(docs).collect()))
    hot = frozenset({("en", b"new"), ("und", b"new"), ("en", b"aaaaaaaa")})
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parts = collocations.stripes(own, 1, hot)
    assert parts.where("part > 0").count() > 0
    found = collocations.merged(parts, 10).where("not whole and prefix = cast('new' as binary)").collect()
    assert {(r["lang"], bytes(r["next"])): r["a"] for r in found} == {("en", b"york"): 30, ("und", b"york"): 60}
    monkeypatch.setattr(collocations, "_hot_words", lambda docs: hot)
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == want


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BATCH_BYTES", 50)
    text = b"".join(b"w%d x y. " % i for i in range(100))
    parts = list(collocations._cut(text))
    assert len(parts) > 5 and b".".join(parts).replace(b"\n", b".") == text
    assert list(collocations._cut(b"a " * 100)) == [b"a " * 100]


# -- lines ----------------------------------------------------------------------------


def test_near_lines_share_a_band(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdefghij klm"), size=n)).strip() for n in rng.integers(8, 400, 400)]
    found = recall.missed(spark, [t for t in texts if t])
    assert len(found) > 10
    for (kind, at), (n, lost) in found.items():
        assert lost <= max(1, 0.05 * n), (kind, at, n, lost)
