"""Each operator against a plain version, on small fixtures with awkward rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import (
    bpe,
    catalog,
    chat,
    components,
    fingerprints,
    language,
    lines,
    mixing,
    quality,
    sharding,
    simhash,
    toxicity,
)
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
BLANK = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(BLANK, text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return documents_of(spark)


def documents_of(spark):
    return cases.documents(spark).cache()


# -- BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def test_bpe_is_the_library(vocabulary):
    rng = np.random.default_rng(3)
    letters = ["".join(rng.choice(list("abcdhint'é1 -"), size=n)) for n in rng.integers(1, 60, 400)]
    texts = ["", "<|endoftext|>a<|startoftext|> B", "ΣΑΣ İ", "a" * 3000, "don't WE'LL\x1c\x85x", *letters]
    own = bpe.Encoder(vocabulary).encode(texts)
    tokenizer = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, own, strict=True):
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == expected
        assert bpe.decode(ids, vocabulary.names) == tokenizer.decode(expected, skip_special_tokens=False)


def test_bpe_short_and_long_merging_agree(vocabulary):
    for word in ("internationalisation", "hahahahahahaha", "xyzzyxyzzy", "aaaaaaaaaaa"):
        start = [vocabulary.proposed[c] for c in word[:-1]] + [vocabulary.proposed[word[-1] + bpe.WORD_END]]
        assert vocabulary.merge(word) == vocabulary._merge_long(start)


def test_bpe_remembers_within_bounds(vocabulary):
    known = bpe.Remembered(10)
    for k in range(40):
        for new in known.missing([f"w{k}", "always"]):
            known.young[new] = k
        assert "always" in known.young
    assert len(known.young) + len(known.old) <= 13


def test_bpe_query(spark, docs, tmp_path):
    folder = cases.saved(spark, tmp_path, documents=docs)
    got = Counter(tuple(r) for r in catalog.queries()["op2_bpe"](spark, folder).collect())
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for row in docs.collect():
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids
        said = tokenizer.decode(ids, skip_special_tokens=False)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        expected[
            (
                row["doc_id"],
                len(ids),
                hashlib.sha256(packed).hexdigest(),
                hashlib.sha256(said.encode()).hexdigest(),
            )
        ] += 1
    assert got == expected


def test_bpe_columns(spark, docs):
    coded = docs.select("text", bpe.encoder(spark, PATH)("text").alias("i"))
    said = coded.select("text", bpe.decoder(spark, PATH)("i").alias("said")).collect()
    tokenizer = Tokenizer.from_file(PATH)
    for row in said:
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["said"] == tokenizer.decode(ids, skip_special_tokens=False)


# -- SimHash --------------------------------------------------------------------------


def plain_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    n = max(1, len(w) - 3)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def test_fingerprint():
    for text in (None, "", " \t", "One", "One two THREE", "É È a b c d", cases.PROSE, cases.LONG):
        assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_cells_find_every_link(spark):
    """Random marks, a tight cluster and a chain, with cells much smaller than the cluster."""
    rng = np.random.default_rng(5)
    marks = set(rng.integers(0, 1 << 62, 300).tolist())
    for k in range(300):
        marks.add(0x0F0F0F0F0F0F0F0F ^ sum(1 << int(b) for b in rng.integers(0, 64, k % 5)))
    chain = 0x123456789ABCDEF0
    for step in range(12):
        chain ^= 0b111 << (step * 5)
        marks.add(chain)
    marks = np.array(sorted(m - (1 << 64) if m >> 63 else m for m in marks), dtype=np.int64)
    root = {int(m): int(m) for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bits = marks.view(np.uint64)
    for i in range(len(marks)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= 4) + i + 1:
            a, b = find(int(marks[i])), find(int(marks[j]))
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(int(m),) for m in marks], "mark long")
    found = components.components(simhash.links_between(df, cell=40)).collect()
    got = {r["node"]: r["root"] for r in found}
    assert {int(m): got.get(int(m), int(m)) for m in marks} == {int(m): find(int(m)) for m in marks}
    assert len(got) > 200


def test_components_of_a_long_chain_and_nulls(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3), (3, None)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_simhash_rows(spark, docs):
    rows = docs.select("doc_id", simhash.fingerprints(F.col("text")).alias("mark"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.with_components(rows).collect()}
    assert got[1] == got[2] == 1 and got[4] == got[5] == got[9] == 4 and got[7] == 7
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8]


# -- language -------------------------------------------------------------------------


def plain_phrases(sample, text):
    """All of the text's symbols occur in the sample."""
    phrases = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        phrases, at = phrases + 1, end
    return phrases


def test_phrases_are_longest_matches():
    rng = np.random.default_rng(2)
    sample = rng.integers(2, 6, 400)
    moves = language.suffix_automaton(sample, 8)
    joined = "".join(map(str, sample))
    for size in (1, 5, 60, 300):
        text = rng.integers(2, 6, size)
        got = language.count_phrases(moves, text, np.array([0]), np.array([size]))[0]
        assert got == plain_phrases(joined, "".join(map(str, text)))


def test_unknown_symbol_ends_a_phrase():
    moves = language.suffix_automaton(np.array([2, 3, 2, 3]), 6)
    count = lambda *s: language.count_phrases(moves, np.array(s), np.array([0]), np.array([len(s)]))[0]
    assert (count(2, 3, 2), count(5), count(2, 5), count(5, 5), count(2, 5, 3)) == (1, 1, 1, 2, 2)


def test_many_letters_take_no_more_room():
    """Han and Hangul labels: the automaton's size follows the sample, not the alphabet."""
    rng = np.random.default_rng(8)
    write = lambda low, n: ["".join(map(chr, rng.integers(low, low + n, 300))) for _ in range(150)]
    samples = {"zh": write(0x4E00, 5000), "ko": write(0xAC00, 8000), "en": write(ord("a"), 26)}
    model = language.train(samples)
    assert model.languages == ["en", "ko", "zh"] and len(model.letters) > 12000
    for cells, n in zip(model.automata, model.sizes, strict=True):
        assert n <= language.SAMPLE_SYMBOLS and len(cells) <= 8 * n + 4 * (len(model.letters) + 2)
    codes = model.symbol_table()
    for name, texts in samples.items():
        assert language.predict(model, [t[:120] for t in texts[:20]], codes)[0] == [name] * 20
    small, _ = language.symbols_of(samples["zh"][:3], codes)
    cells = language.suffix_automaton(small, len(model.letters) + 2)
    text = np.concatenate([small[40:90], small[300:420], small[:30]])
    got = language.count_phrases(cells, text, np.array([0]), np.array([len(text)]))[0]
    assert got == plain_phrases("".join(map(chr, small + 100)), "".join(map(chr, text + 100)))


def test_every_sampled_text_has_its_share():
    codes = language.train({"x": ["abcdefg"]}).symbol_table()
    symbols, begins = language.symbols_of(["a" * 1000, "b" * 10, "c" * 1000, "..."], codes)
    got = language.even_sample(symbols, begins, 300).tolist()
    counts = [got.count(codes[ord(c)]) for c in "abc"]
    assert len(got) <= 300 and counts[1] == 10 and counts[0] == counts[2] > 130
    assert language.even_sample(*language.symbols_of([], codes), 300).tolist() == [1]


def test_language_rows(spark, docs):
    few = {"en": ["the dog and the cat are here with them"], "de": ["der hund und die katze sind hier bei ihnen"]}
    model = language.train(few)
    found = docs.select("doc_id", "text", language.identifier(spark, model)("text").alias("f")).collect()
    by = {r["doc_id"]: r["f"] for r in found}
    assert by[4]["lang"] == by[5]["lang"] == by[9]["lang"] == "und" and by[4]["score"] == 0
    assert by[6]["lang"] == "en" and all(0 <= r["f"]["score"] <= 1 for r in found)
    none = language.train({})
    assert language.predict(none, ["text"], none.symbol_table()) == (["und"], [0.0])


def test_stage_writes_the_language_found(spark):
    english, german = "the dog and the cat are here with them", "der hund und die katze sind hier bei ihnen"
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % language.FOLDS == language.HELD_OUT]
    other = [i for i in range(200) if i not in held]
    rows = [(i, f"{english} {i}", "en", 1) for i in other[:20]] + [(i, f"{german} {i}", "de", 1) for i in other[20:40]]
    rows += [(held[0], german, "en", 1), (held[1], english, None, 1), (other[40], german, None, 1)]
    rows += [(held[2], "12 34", "en", 1), (held[3], None, "de", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    out = language.with_language(docs)
    found = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert out.columns == docs.columns and len(found) == 43
    assert (found[held[0]], found[held[1]], found[other[40]]) == ("de", "en", "de")
    assert all(found[i] == label for i, _, label, _ in rows[:40])
    clashing = docs.withColumns({"_found": F.lit(7), "found": F.lit("x"), "a.b": F.lit(1)})
    assert language.with_language(clashing).select("_found", "found", "`a.b`").distinct().collect() == [(7, "x", 1)]


def test_language_held_out_accuracy(spark):
    rows = language.op7_language(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right, n = rows.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


# -- mixing ---------------------------------------------------------------------------


def test_targets_are_filled_in_order(spark):
    rows = [("a", 100), ("b", 10), ("c", 1000), (None, 50)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    # weights 3, 1, 2, 3; 1.5 * 1160 = 1740; a, b and the null source stop at twice their size
    assert got == {"a": 200, "b": 20, None: 100, "c": 1420}


def test_mix_meets_targets_and_budget(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "xyz"[int(rng.integers(0, 3))], int(s)) for i, s in enumerate(rng.integers(0, 50, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.weighted_mix(df, rows_per_range=200).toPandas()
    again = mixing.weighted_mix(df.orderBy(F.rand(1)), rows_per_range=70).toPandas()
    same = got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert same and (got["taken"] <= 2 * got["size"]).all() and len(got) == 3000
    assert got["taken"].sum() == got["size"].sum() * 3 // 2
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per["taken"] - per["target"]) <= 50).all()


def test_mix_rows(spark, docs):
    sized = docs.drop("size").withColumn("size", F.size(F.split(F.coalesce("text", F.lit("")), " ")))
    got = mixing.weighted_mix(sized)
    assert got.count() == docs.count() and set(got.columns) >= set(docs.columns) - {"target", "taken"}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


# -- sharding -------------------------------------------------------------------------


def test_differencing_is_tight():
    rng = np.random.default_rng(4)
    sizes = [[int(s), 0, 0, 0] for s in rng.integers(1, 10_000, 500)]
    placed = sharding.difference(sizes)
    sums = Counter()
    for (size, *_), shards in zip(sizes, placed, strict=True):
        sums[shards[0]] += size
    assert max(sums.values()) - min(sums.values()) <= 50 and sorted(placed[0]) == [0, 1, 2, 3]


def test_shards_in_levels_with_a_hot_group(spark):
    rows = [(i, 100 if i % 3 == 0 else i % 90 + 1, "hot" if i % 3 == 0 else f"g{i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, size long, grp string")
    got = sharding.balanced_shards(df, shards=4, block=60).toPandas()
    assert len(got) == 3000
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 4 and sums.max() - sums.min() < 0.02 * sums.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert (got[got["grp"] != "hot"].groupby("grp")["shard"].nunique() == 1).all()


def test_groups_that_fit_stay_whole(spark):
    """Groups of 0.2% to 6% of all bytes beside many small ones; only one beyond a fair shard is cut."""
    rows = [(i, i % 97 + 1, f"g{i}") for i in range(4000)]
    for name, n in (("a", 60), ("b", 30), ("c", 200), ("d", 190), ("e", 4), ("beyond", 900)):
        rows += [(len(rows) + k, 100, name) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, size long, grp string")
    got = sharding.balanced_shards(df, block=1024).toPandas()
    assert len(got) == len(rows)
    fair = got["size"].sum() / sharding.SHARDS
    spread = got.groupby("grp")["shard"].nunique()
    sizes = got.groupby("grp")["size"].sum()
    assert (sizes[["a", "b", "c", "d"]] > fair / 64).all() and sizes["beyond"] > fair
    assert (spread[sizes <= fair] == 1).all() and spread["beyond"] > 1
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == sharding.SHARDS and sums.max() - sums.min() < 0.01 * fair


def test_shard_query(spark, docs, tmp_path):
    got = catalog.queries()["op4_sharding"](spark, cases.saved(spark, tmp_path, documents=docs)).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[5]["size"] == 1 and by[5]["text_crc32"] == 0 and by[8]["size"] > 20
    assert by[1]["text_crc32"] == zlib.crc32(cases.PROSE.encode())


# -- fingerprints ---------------------------------------------------------------------


def plain_hashes(text):
    w, out = words(text), set()
    for i in range(max(1, len(w) - 4)):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        if w:
            out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(out)


def test_fingerprints_by_hand(spark, docs, tmp_path):
    got = fingerprints.compared(docs).collect()
    assert len(got) == docs.count()
    distinct = {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    ring = sorted((d for d in distinct if d[0] is not None), reverse=True) + [d for d in distinct if d[0] is None]
    texts = dict(ring)
    following = {a[0]: b for a, b in zip(ring, ring[1:] + ring[:1], strict=True)}
    for row in got:
        text, following_text = texts[row["doc_id"]], following[row["doc_id"]][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following_text[:half]
        assert row["n_chars"] == len(text) and row["next_id"] == following[row["doc_id"]][0]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        kept = re.sub("^[^:]*:", "", row["fingerprint"])
        hashes = [int(kept[i : i + 16], 16) for i in range(0, len(kept), 16)]
        expected = plain_hashes(text)
        assert [h - (1 << 64) if h >> 63 else h for h in hashes] == [h for h in expected if h <= fingerprints._BOUND]
        for name, other in (("near_edited", edited), ("near_next", following_text)):
            x, y = set(expected), set(plain_hashes(other))
            a, b = ({h for h in z if h <= fingerprints._BOUND} for z in (x, y))
            want = 1.0 if x == y else len(a & b) / len(a | b) if a | b else 0.0
            assert abs(row[name] - want) < 1e-12


def test_merged_and_contained(spark):
    a, b = " ".join(f"x{i}" for i in range(3000)), " ".join(f"x{i}" for i in range(1000, 1600))
    s = fingerprints.sketch
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        fingerprints.containment(s(F.col("b")), s(F.col("a"))).alias("inside"),
        fingerprints.likeness(s(F.col("a")), s(F.col("a"))).alias("same"),
        fingerprints.likeness(fingerprints.merged(s(F.col("a")), s(F.col("b"))), s(F.col("a"))).alias("merged"),
    ).first()
    assert row["inside"] == 1 and row["same"] == 1 and row["merged"] == 1


# -- quality --------------------------------------------------------------------------


def test_quality_counts(spark, docs):
    by = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert by[5]["n_words"] == 0 and by[5]["base_failed"] and not by[5]["kept"]
    assert by[1]["n_words"] == 120 and by[1]["kept"] and by[1]["n_repeat_words"] == 0
    assert by[3]["n_words"] == 30_000 and by[3]["n_repeat_words"] == 30_000 and by[3]["base_failed"]
    assert by[8]["word_chars"] == len("".join(words(dict((r[0], r[1]) for r in cases.ROWS)[8])))
    assert by[6]["n_dup_lines"] == 0


def test_repeated_words_count_each_word_once(spark):
    texts = ["a b c a b c a b c", "a a a a", "a b c d", "x y", "q a b c z a b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    w = F.split("t", " ")
    assert [r[0] for r in rows.select(quality.repeated_words(w)).collect()] == [9, 4, 0, 0, 6]


def test_boilerplate_goes_and_copies_stay(spark):
    def prose(i):
        return " ".join(f"w{i}x{k}" for k in range(60))

    shared = " ".join(f"menu{k}" for k in range(200))
    rows = [(i, f"{shared}\n{prose(i)}", "h") for i in range(8)]
    rows += [(100 + i, prose(1000), "h") for i in range(30)]
    rows += [(200 + i, f"{shared.upper()} \n{prose(i)}", "other") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, limit=5).collect()}
    assert not any(kept[i] for i in range(8))
    assert all(kept[100 + i] for i in range(30)) and all(kept[200 + i] for i in range(3))


# -- lines ----------------------------------------------------------------------------


def plain_kept(rows):
    first = {}
    for doc, text in rows:
        tag = xxhash.xxh64_intdigest(text.encode(), 42)
        tag -= (1 << 64) if tag >> 63 else 0
        for pos, line in enumerate(text.split("\n")):
            norm = line.strip(" \t\n\x0b\x0c\r").lower()
            if norm:
                at = (doc, tag, pos)
                first[norm] = min(first.get(norm, at), at)
    names = list(first)
    cut = [[*n.split(), ""] for n in names]
    sets = [{(a, b[: lines.CHARS]) for a, b in zip(w, w[1:], strict=False)} for w in cut]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= lines.SIMILARITY * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, n in enumerate(names):
        best[find(i)] = min(best.get(find(i), first[n]), first[n])
    return Counter((doc, pos) for doc, _, pos in best.values())


def test_lines_like_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = [f"term{i}" for i in rng.integers(0, 5000, 40)]
    rows = []
    for doc in range(60):
        near = list(base)
        for _ in range(doc % 2):
            near[int(rng.integers(0, 40))] = f"other{doc}"
        rows.append((doc, "\n".join([" ".join(near), f"line number {doc} of many", " ".join(f"q{doc}v{k}" for k in range(12)), ""])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lines.kept_lines(docs).select("doc_id", F.explode("kept").alias("pos"))
    got = Counter((r["doc_id"], r["pos"]) for r in kept.collect())
    assert got == plain_kept(rows)


def true_similarity(a, b):
    """Jaccard similarity of the sets of 5 code points from each position; shorter texts whole."""
    x, y = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def kept_of_all_pairs(texts):
    """Places of the lines that stay of one document with these different lines."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if true_similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def test_lines_shingle_every_character(spark):
    """One character changed in long words, in lines without spaces, in other scripts."""
    words_ = "an incomprehensibly intergovernmental counterrevolutionary misunderstanding here"
    han = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    astral = "".join(chr(0x1F300 + i) for i in range(60))
    tabbed = "\t".join(f"column{i}value" for i in range(9))
    url = "https://example.org/archive/2024/some-rather-long-path/with/parts?query=none&more=yes"
    texts = []
    for t in (words_, han, astral, tabbed, url):
        texts += [t, t[:20] + "q" + t[21:], t[::-1]]
    texts += ["abcd", "abce", "abcde"]
    docs = spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")
    kept = lines.deduplicate_lines(docs).first()["kept"]
    assert kept == kept_of_all_pairs(texts)
    assert all(k in kept and k + 1 not in kept for k in range(0, 15, 3))


def test_lines_of_few_shingles_all_meet(spark):
    """Short lines of every size that gain or change characters, down to a similarity of 0.8."""
    rng = np.random.default_rng(11)
    texts = {"the full privacy policy", "see the full privacy policy", "abcdefgh", "abcdefghi"}
    for size in range(8, 90):
        base = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size))
        longest = (size - 4) // 4
        texts |= {base, "".join(rng.choice(list("0123456789"), longest)) + base}
        if size >= 49:
            texts.add(base[:20] + "#" + base[21:])
    texts = sorted(texts)
    rng.shuffle(texts)
    docs = spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")
    kept = lines.deduplicate_lines(docs).first()["kept"]
    assert kept == kept_of_all_pairs(texts)
    assert len(kept) < len(texts) - 70


def test_sets_of_few_shingles_share_a_key(spark):
    """Random sets at the least similarity; the smaller has at most ``SHORT`` hashes."""
    rng = np.random.default_rng(12)
    rows = []
    for pair in range(1500):
        differ = int(rng.integers(1, 17))
        common = 4 * differ
        union = rng.integers(-(2**63), 2**63, common + differ, dtype=np.int64).tolist()
        own = int(rng.integers(0, differ + 1)) if common + differ <= lines.SHORT else 0
        rows.append((2 * pair, union[: common + own]))
        rows.append((2 * pair + 1, union[:common] + union[common + own :]))
    sets = spark.createDataFrame(rows, "id long, hashes array<long>")
    keys = lines.banded(sets).select(F.expr("id div 2").alias("pair"), "id", "key").distinct()
    met = keys.groupBy("pair", "key").count().where("count = 2").select("pair").distinct().count()
    assert met == 1500


def test_lines_rows(spark, docs):
    found = lines.deduplicate_lines(docs).collect()
    assert len(found) == docs.count()
    by = {r["doc_id"]: r["kept"] for r in found}
    assert by[6] == [0, 4] and by[7] == [1] and by[4] == by[5] == by[9] == [] and by[2] == []
    out = lines.without_duplicate_lines(docs)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[6] == f"{cases.LINE}\nother words in another line" and 2 not in texts


# -- toxicity -------------------------------------------------------------------------


def test_token_features():
    own = toxicity.TokenFlags(frozenset({"idiot", "vequ*"}))
    row = dict(zip(toxicity.FEATURES, own.features("You IDIOT!! 1d10t vequmo soooo calm"), strict=True))
    assert row["lexicon_hits"] == 3 and row["obfuscated_hits"] == 1 and row["near_second_person"] == 1
    assert row["stretched_word_rate"] == pytest.approx(1 / 6) and row["shouted_rate"] == pytest.approx(1 / 6)
    assert own.features("") == [0.0] * len(toxicity.FEATURES)


def test_toxicity_learns(spark):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = " ".join(f"w{k}" for k in rng.integers(0, 300, 40)) + (" you rotten scum" if bad else " fine day")
        rows.append((i, text))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None), (9000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels, F.col("text")).toPandas()
    assert len(got) == 602 and got["score"].between(0, 1).all()
    toxic = got["doc_id"].isin([i for i, b in marks if b])
    assert ((got["score"] >= toxicity.THRESHOLD) == toxic).mean() > 0.98


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scored(docs, none, F.col("text")).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.0}


# -- chat -----------------------------------------------------------------------------

MESSAGES = "tree string, id long, parent long, role string, text string, score double"


def test_best_branch_of_each_tree(spark):
    rows = [
        ("t", 1, None, "user", "root", 0.0),
        ("t", 2, 1, "assistant", "good <|im_end|> \\ [INST]", 5.0),
        ("t", 3, 1, "assistant", "bad", 1.0),
        ("t", 4, 2, "us\ner", None, None),
        ("t", 5, 99, "user", "other root", 0.5),
        ("r", 1, 2, "user", "ring", 1.0),
        ("r", 2, 1, "user", "ring", 1.0),
    ]
    df = spark.createDataFrame(rows, MESSAGES)
    out = chat.conversations(df).collect()
    assert len(out) == 1 and out[0]["leaf"] == 4
    turns = chat.read_back(out[0]["formatted"])
    assert turns == [("user", "root"), ("assistant", "good <|im_end|> \\ [INST]"), ("us\ner", "")]
    text = out[0]["formatted"]
    loss = "".join(chat.unescape(text[m["begin"] : m["end"]]) for m in out[0]["mask"])
    assert loss == "good <|im_end|> \\ [INST]" and text.count(chat.TURN) == 3
    assert chat.conversations(df, branches=3).count() == 3
    assert chat.conversations(df.limit(0)).count() == 0


def test_null_tree_and_rings(spark):
    rows = [
        (None, 1, None, "user", "asked", 1.0),
        (None, 2, 1, "assistant", "answered", 1.0),
        (None, 5, 6, "user", "ring", 1.0),
        (None, 6, 5, "user", "ring", 1.0),
        ("", 1, None, "user", "empty name", 1.0),
        ("#", 1, None, "user", "mark", 1.0),
        ("r", 1, 2, "user", "ring", 1.0),
        ("r", 2, 1, "user", "ring", 1.0),
        ("r", 3, 2, "user", "below", 1.0),
        ("r", 4, None, "user", "beside", 1.0),
    ]
    df = spark.createDataFrame(rows, MESSAGES)
    with pytest.warns(UserWarning, match="ring"):
        out = chat.conversations(df).collect()
    assert {r["tree"]: chat.read_back(r["formatted"]) for r in out} == {
        None: [("user", "asked"), ("assistant", "answered")],
        "": [("user", "empty name")],
        "#": [("user", "mark")],
        "r": [("user", "beside")],
    }
    ringed = {(r["tree"], r["id"]) for r in chat.ring_messages(df).collect()}
    assert ringed == {(None, 5), (None, 6), ("r", 1), ("r", 2), ("r", 3)}


def test_deep_chain(spark):
    rows = [("t", i, i - 1 if i else None, "user", str(i), 1.0) for i in range(300)]
    out = chat.conversations(spark.createDataFrame(rows, MESSAGES)).first()
    assert [t for _, t in chat.read_back(out["formatted"])] == [str(i) for i in range(300)]


# -- all of them ----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, name, tmp_path):
    tables = {
        "documents": cases.empty(spark),
        "labels": spark.createDataFrame([], "doc_id long, toxic int"),
        "conversations": spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
    }
    got = catalog.queries()[name](spark, cases.saved(spark, tmp_path, **tables)).collect()
    assert len(got) == (1 if name == "op1_chat" else 0)


# those without a row per document have their own tests with awkward rows
BY_DOCUMENT = sorted(set(catalog.queries()) - {"op1_chat", "op11_variants", "op13_collocations"})


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_awkward_rows(spark, docs, name, tmp_path):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    folder = cases.saved(spark, tmp_path, documents=docs, labels=labels)
    got = catalog.queries()[name](spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
