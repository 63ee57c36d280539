"""Operators on documents against brute force on small tables with odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, bytesops, fingerprints, licenses, near_dedup, packing, quality, suffix_dedup
from tessera.llm.entry import BYTE_BPE, WORD_BPE
from tessera.llm.shared import Scratch
from tests.llm import cases


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def both(spark):
    """The odd cases, and the smallest driver table."""
    return [cases.documents(spark), cases.sample(spark)]


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


# -- hashing -------------------------------------------------------------------


@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 9))
def test_leftmost_argmin(values, width):
    got = bytesops.leftmost_argmin(np.array(values, dtype=np.uint64), width)
    assert list(got) == [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]


def test_words_do_not_depend_on_blocks(monkeypatch):
    raw = (cases.LONG + " é\tß").encode()
    one = bytesops.word_hashes(raw)
    monkeypatch.setattr(bytesops, "BLOCK", 1000)
    assert (bytesops.word_hashes(raw) == one).all()
    assert len(one) == len(raw.split())


# -- near-duplicates -----------------------------------------------------------


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(docs):
    """Brute force: every pair of documents."""
    sets = [(i, shingles(t)) for i, t in docs]
    top = {i: i for i, _ in sets if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {(i, len(s), find(i), find(i) == i) if i is not None else (i, len(s), None, True) for i, s in sets}


def test_near_duplicates(spark):
    for docs in both(spark):
        got = rows_of(near_dedup.near_duplicates(docs))
        assert set(got) == linked(texts_of(docs))
    assert rows_of(near_dedup.near_duplicates(cases.empty(spark))) == []


def test_unequal_texts_under_one_id_link_no_strangers(spark):
    own = {k: " ".join(f"{k}{n}" for n in range(80)) for k in "ab"}
    docs = [(5, own["a"]), (5, own["b"]), (6, own["a"] + " x"), (7, own["b"] + " x"), (4, own["b"] + " y")]
    got = sorted(rows_of(near_dedup.near_duplicates(cases.documents(spark, docs))))
    assert got == [(4, 77, 4, True), (5, 76, 4, False), (5, 76, 5, True), (6, 77, 5, False), (7, 77, 4, False)]


def chain(n, words=60):
    """Documents of which neighbours are alike and far ones are not."""
    base = [f"t{k}" for k in range(words)]
    out = []
    for i in range(n):
        base = [*base]
        base[(i * 7) % words] = f"new{i}"
        out.append((100 + (i * 37) % n, " ".join(base)))
    return out


def test_chains_and_buckets_with_several_components(spark):
    shared = " ".join(f"s{k}" for k in range(40))
    families = [(1000 + 10 * f + v, shared + " " + " ".join(f"f{f}x{k}" for k in range(30)) + f" v{v}") for f in range(12) for v in range(3)]
    docs = chain(40) + families + [(5000 + k, "one common line of words in all of them") for k in range(50)]
    got = rows_of(near_dedup.near_duplicates(cases.documents(spark, docs)))
    assert set(got) == linked(docs)


@pytest.mark.parametrize("cell", [near_dedup.CELL, 3])
def test_second_pass_finds_links_that_no_hub_shows(spark, cell):
    """Members of one bucket that are alike, but not like its smallest member; a component over many blocks."""
    long = "k l m n o " * 3 + " ".join(f"u{k}" for k in range(60))
    docs = [(1, "p q r s t u v w x y z"), *((k, long + f" x{k}") for k in range(2, 14)), *((k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(20, 26))]
    table = near_dedup.sketched(cases.documents(spark, docs))
    nodes = table.select(F.col("doc_id").alias("node"), F.struct("doc_id", "h").alias("doc"), F.col("n_shingles").alias("n"), "bands", "sketch")
    labels = {k: 2 if 2 <= k < 9 else k for k, _ in docs}  # the first pass joined some
    rest = spark.createDataFrame([(9, 0, k, labels[k]) for k, _ in docs if k > 1], "band long, place int, node long, label long")
    merged = near_dedup._second_pass(rest, nodes, cases.documents(spark, docs), 75, Scratch(spark), cell)
    assert dict(rows_of(merged)) == {k: 2 for k in range(9, 14)}


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.6, 0.75, 0.9):
        common = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        k = int(2000 * (1 - share) / (2 * share))
        one, two = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for _ in range(2))
        _, sketch = near_dedup.signatures([one, two])
        differing = int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum())
        n, m = near_dedup.BITS, near_dedup.BANDS * near_dedup.ROWS
        estimate = 1 + n / (4 * m) * np.log(1 - 2 * differing / n)
        assert abs(estimate - share) < 0.1


def test_sketches_lose_fewer_pairs_than_bands():
    """Exactly: of 250 samples each differs with probability 1/4, and one that differs flips two of the bits."""
    n, m, share = near_dedup.BITS, near_dedup.BANDS * near_dedup.ROWS, 0.75
    odd = np.arange(n + 1)
    chance, lost = (odd == 0).astype(float), 0.0  # of each number of odd bits
    limit = near_dedup.most_differing(share - near_dedup.MARGIN)
    for differ in range(m + 1):
        lost += math.comb(m, differ) * (1 - share) ** differ * share ** (m - differ) * chance[limit + 1 :].sum()
        for _ in range(2):
            up, down = chance * (n - odd) / n, chance * odd / n
            chance = np.append(0, up[:-1]) + np.append(down[1:], 0)
    assert 0 < lost < (1 - share**near_dedup.ROWS) ** near_dedup.BANDS / 10


@pytest.mark.parametrize("local", [near_dedup.LOCAL, 0])
def test_components_of_paths_and_stars(spark, local):
    edges = [(k, k + 1) for k in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "hub long, member long")
    got = dict(rows_of(near_dedup.components(df, Scratch(spark), "c", local)))
    assert got == {k: 0 for k in range(1, 51)} | {100 + k: 100 for k in range(1, 30)}


# -- repeated windows ----------------------------------------------------------


def removed(docs, depth):
    raw = [t.encode() for _, t in docs]
    seen = Counter(t[i : i + depth] for t in raw for i in range(len(t) - depth + 1))
    out = []
    for (doc_id, _), t in zip(docs, raw, strict=True):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((doc_id, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("hot", "split"), [(suffix_dedup.HOT, suffix_dedup.SPLIT), (0, 0), (suffix_dedup.HOT, 0)])
def test_repeated_windows(spark, hot, split):
    docs = cases.documents(spark)
    assert Counter(rows_of(suffix_dedup.repeated_report(docs, hot=hot, split=split))) == removed(texts_of(docs), 200)


@given(st.lists(st.binary(min_size=20, max_size=40), min_size=1, max_size=12), st.sampled_from([1, 5, 8, 16, 20]))
@settings(max_examples=200, deadline=None)
def test_radix_sort_leaves_equal_windows_in_order(raw, depth):
    raw = [bytes(b % 3 for b in r) for r in raw]
    data, which, place, starts = suffix_dedup._windows(raw, depth)
    group = which // 3
    alive = suffix_dedup._radix(data, starts, group, depth)
    keys = [(g, bytes(data[s : s + depth])) for g, s in zip(group.tolist(), starts.tolist(), strict=True)]
    count = Counter(keys)
    assert [keys[k] for k in alive] == sorted(k for k in keys if count[k] > 1)


def test_repeated_windows_of_the_small_table(spark):
    docs = cases.sample(spark)
    assert Counter(rows_of(suffix_dedup.repeated_report(docs))) == removed(texts_of(docs), 200)
    assert rows_of(suffix_dedup.repeated_report(cases.empty(spark))) == []


def test_short_windows_over_few_letters(spark):
    rng = np.random.default_rng(4)
    docs = [(k, "".join(rng.choice(list("ab é"), rng.integers(0, 60)))) for k in range(60)]
    assert Counter(rows_of(suffix_dedup.repeated_report(cases.documents(spark, docs), depth=8, anchor=3))) == removed(docs, 8)


def test_long_text_in_blocks(spark, monkeypatch):
    own = list(suffix_dedup._blocks([cases.LONG.encode()], 200))
    assert len(own) == 1  # under four blocks
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 5000)
    parts = list(suffix_dedup._blocks([cases.LONG.encode()], 200))
    assert len(parts) > 10 and sum(len(d) - 199 for d, *_ in parts) == len(cases.LONG) - 199


def test_texts_without_repeats(spark):
    docs = cases.documents(spark)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == docs.count()
    assert PASSAGE_GONE(got[8]["text"]) and PASSAGE_GONE(got[9]["text"]) and got[18]["text"] == ""
    assert got[1]["text"] == cases.DOCUMENTS[0][1] and got[3]["text"] is None and got[3]["n_chars"] is None
    assert got[9]["n_chars"] == len(got[9]["text"])


def test_columns_of_clashing_names_stay(spark):
    names = ["_text", "_spans", "_h", "_span_id", "_SPAN_H"]
    docs = cases.documents(spark)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.select(names).collect()} == {tuple(range(5))}
    kept = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs.withColumn("_key", F.lit(7)).withColumn("_gone", F.lit(8)), "")
    assert {tuple(r) for r in kept.select("_key", "_gone").collect()} == {(7, 8)}


def PASSAGE_GONE(text):
    return "passage30" not in text


# -- packing -------------------------------------------------------------------


def test_pieces_are_the_tokenizers(spark):
    own = Tokenizer.from_file(WORD_BPE)
    for docs in both(spark):
        want = Counter()
        for doc_id, text in texts_of(docs):
            raw = np.array([*own.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
            for k in range(0, len(raw), 2048):
                part = raw[k : k + 2048]
                want[(doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
        assert Counter(rows_of(packing.pieces(docs, WORD_BPE))) == want


def test_words_are_the_tokenizers():
    """Every fourth text of the middle table, and odd ones."""
    import duckdb

    own = Tokenizer.from_file(WORD_BPE)
    ids = packing.TokenIds(WORD_BPE)
    assert ids.merges
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{cases.DATA}/sf0.01/documents.parquet'").fetchall()][::4]
    odd = ["İI ŉ ǅ Σς ΑΣ é é ß ﬁ ²½ a1b2 don't 'RE x's <|endoftext|> <|endoftext|>. ͅ 日本 \u00a0x\u2028y\x1cz ..  .a a. .", "ǅǆ K Å ſs Ⱥ_b __ ÷× \0 \x7f\x85 a\tb", "", "\n", "\0", "a_1'll 've'd"]
    together = ids.encode_all(texts + odd)
    for text, got in zip(texts + odd, together, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_every_ordinary_character_is_the_tokenizers():
    ids = packing.TokenIds(WORD_BPE)
    for n in range(0x250):
        text = f"a{chr(n)}B {chr(n)}{chr(n)} {chr(n)}1'{chr(n)} '{chr(n)}e"
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, n


@given(st.text(st.sampled_from("aZéßİſσΣ'.,!-1 \n\u0301\u0345日"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_odd_runs_are_the_tokenizers(text):
    own = packing._KNOWN.setdefault(WORD_BPE, None) or packing.TokenIds(WORD_BPE)
    packing._KNOWN[WORD_BPE] = own
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_a_text_are_tokens(spark):
    text = "a <|endoftext|> b<|startoftext|>."
    want = Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids
    assert 49407 in want
    assert np.frombuffer(packing.TokenIds(WORD_BPE).encode(text), "<u4").tolist() == want


def test_long_texts_are_encoded_in_parts():
    ids, text = packing.TokenIds(WORD_BPE), cases.LONG * 2 + "\n" + "é" * 70_000 + " end."
    assert b"".join(map(ids.encode, packing._runs_of(text, 1000))) == ids.encode(text)
    assert len(list(packing._runs_of(text, 1000))) > 300


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert sum(n for _, n in own) <= capacity
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own[:-1]]]))
    return len(by)


def test_packing(spark):
    for docs in both(spark):
        rows = packing.pack_documents(docs, WORD_BPE).collect()
        bins = check_packing(rows, 2048)
        assert len(rows) == packing.pieces(docs, WORD_BPE).count()
        assert bins <= packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=2049), 2048) + 1
    assert rows_of(packing.pack_documents(cases.empty(spark), WORD_BPE)) == []


def test_packing_over_many_partitions_exchanges_pieces(spark):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 600, 4000), rng.integers(600, 2049, 1500)])
    found = spark.createDataFrame([(i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], packing._PIECES)
    rows = packing.packed(found, Scratch(spark), each=400).collect()
    assert len(rows) == len(sizes) and {r["doc_id"] for r in rows} == set(range(len(sizes)))
    bins, bound = check_packing(rows, 2048), packing.lower_bound(np.bincount(sizes, minlength=2049), 2048)
    assert bins <= bound + 1
    assert packing.certificate(spark.createDataFrame(rows)) == (bins, bound)


def test_an_exchange_that_saves_nothing_ends_packing(spark):
    """Pieces of 700: the bound is by thirds, two to a bin, never certified by more exchanges than there are partitions."""
    found = spark.createDataFrame([(i, 0, 0, 700, 0) for i in range(1000)], packing._PIECES)
    rows = packing.packed(found, Scratch(spark), each=10).collect()
    assert len(rows) == 1000 and check_packing(rows, 2048) == 500


@given(st.lists(st.integers(1, 10), max_size=7))
def test_lower_bound_holds(sizes):
    def fewest(items, bins):
        if not items:
            return len(bins)
        best = len(items) + len(bins)
        for k in sorted(set(bins)):
            if k + items[0] <= 10:
                rest = [*bins]
                rest.remove(k)
                best = min(best, fewest(items[1:], [*rest, k + items[0]]))
        return min(best, fewest(items[1:], [*bins, items[0]]))

    bound = packing.lower_bound(np.bincount(sizes, minlength=11), 10) if sizes else 0
    assert bound <= fewest(sorted(sizes, reverse=True), [])


# -- licences ------------------------------------------------------------------


def test_licenses(spark):
    for docs in both(spark):
        want = cases.oracle(licenses.ORACLE, documents=docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}).drop_duplicates().dropna(subset="doc_id"))
        got = licenses.license_report(docs).toPandas().drop_duplicates().dropna(subset="doc_id")
        cases.same(got, want)
    assert rows_of(licenses.license_report(cases.empty(spark))) == []


def test_license_labels(spark):
    got = {r["doc_id"]: r for r in licenses.license_report(cases.documents(spark)).collect()}
    assert got[14]["base_labels"] == "cc-by,mit" and got[14]["labels"] == "cc-by,cc-by-nc,mit" and got[14]["n_base"] == 4
    assert got[17]["base_labels"] == "apache,gpl" and got[17]["n_base"] == 2 and "apache-2.0" in got[17]["labels"]
    assert got[3]["score"] == 0 and got[3]["first_word"] is None and got[3]["n_words"] == 0


def test_whole_licence_texts(spark):
    rows = [(k, f"before it {' '.join(t.words).title()} after") for k, t in enumerate(licenses.TEMPLATES)] + [(99, " ".join(licenses.TEMPLATES[3].words[:40]))]
    docs = cases.documents(spark, rows).withColumn("_words", F.lit("clash")).withColumn("n_words", F.lit(-1)).withColumn("_text", F.lit(None))
    found = licenses.scan(docs)
    assert set(found.columns) == {*docs.columns, "places"}
    got = {r["doc_id"]: r for r in found.collect()}
    for k, t in enumerate(licenses.TEMPLATES):
        assert t.label in [p["label"] for p in got[k]["places"] if p["share"] == 1.0] and got[k]["_words"] == "clash" and got[k]["n_words"] == len(t.words) + 3
    assert 0.1 < max(p["share"] for p in got[99]["places"]) < 0.5


def test_phrases_at_odd_places_against_a_search(spark):
    rng = np.random.default_rng(8)
    vocabulary = [*licenses._vocabulary(), "x", "é", "Mit", "CC", "By"]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 400)))) for k in range(60)] + [(100 + k, " ".join(rng.choice(["cc", "by", "nc", "sa", "mit", "license"], 300))) for k in range(10)]
    got = {r["doc_id"]: sorted((p["label"], p["base"], p["start"]) for p in r["places"]) for r in licenses.scan(cases.documents(spark, rows)).collect()}
    for k, text in rows:
        words = re.findall(licenses.WORD, text.lower())
        assert got[k] == sorted((t.label, t.base, i) for t in licenses.TEMPLATES for i in range(len(words)) if tuple(words[i : i + len(t.phrase)]) == t.phrase)


# -- quality -------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{cases.DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_report(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got["predicted"] == got["quality"]).mean()) > 0.9
    assert got["score"].between(0, 1).all()
    assert quality.quality_report(docs, labels).filter("held_out").count() == docs.filter("crc32(cast(doc_id as string)) % 5 = 0").count()


def test_quality_odd_cases(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (6, 0, 0), (6, 1, 0), (8, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (3, 4, 5)}
    assert len(blank) == 1
    none = quality.quality_report(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_report(cases.empty(spark), labels).collect() == []
    assert quality.without_rejected(docs, labels).columns == docs.columns


def plain_words(text: str) -> list[tuple[int, int]]:
    """Bucket and class of each word, one character class after another."""
    raw, out, at = text.encode(), [], 0
    kind = lambda b: 0 if b in b"\t\n\x0b\x0c\r " else 1 if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 2
    while at < len(raw):
        end = at
        while end < len(raw) and kind(raw[end]) == kind(raw[at]):
            end += 1
        word = raw[at:end]
        if kind(raw[at]):
            value = int(bytesops.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])
            upper = lambda b: 65 <= b <= 90
            shape = 1 if kind(raw[at]) == 2 else 2 if 48 <= word[0] < 58 else 3 if len(word) > 1 and upper(word[0]) and upper(word[-1]) else 4 if upper(word[0]) else 0
            out.append((value % 8192, shape))
        at = end
    return out


def test_word_vectors_and_features_by_their_definition(spark):
    docs = [(i, t) for i, t in cases.DOCUMENTS if t is None or len(t) < 3000]
    words = [plain_words(t or "") for _, t in docs]
    total = defaultdict(lambda: np.zeros(quality.DIMS))
    for own in words:
        for i, (bucket, _) in enumerate(own):
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if j != i:
                    for place, sign in zip(quality._PLACE[own[j][0]], quality._SIGN[own[j][0]], strict=True):
                        total[bucket][place] += sign
    vectors = quality.word_vectors(cases.documents(spark, docs))
    for bucket in range(quality.BUCKETS):
        length = np.linalg.norm(total[bucket]) if bucket in total else 0
        assert np.allclose(vectors[bucket], total[bucket] / length if length else 0, atol=1e-6)
    got = quality.features([(t or "").encode() for _, t in docs], vectors)
    for own, row in zip(words, got, strict=True):
        want = np.zeros(3 * quality.DIMS + 2 + 5)
        if own:
            index = np.zeros((quality.BUCKETS, quality.DIMS))
            for b, _ in own:
                index[b] = 0
                for place, sign in zip(quality._PLACE[b], quality._SIGN[b], strict=True):
                    index[b][place] += sign
            pairs = list(zip(own, own[1:], strict=False))
            want[:32] = sum(vectors[b] for b, _ in own) / len(own)
            want[32:64] = sum(index[b] for b, _ in own) / len(own)
            want[64:96] = sum((vectors[a] * vectors[b] for (a, _), (b, _) in pairs), np.zeros(32)) / len(own)
            want[96] = sum(a == b for (a, _), (b, _) in pairs) / len(own)
            want[97] = math.log1p(len(own)) / 10
            for c in range(5):
                want[98 + c] = sum(s == c for _, s in own) / len(own)
        assert np.allclose(row, want, atol=1e-4)


def test_words_of_long_text_in_blocks():
    words = quality.words_of([cases.LONG.encode() * 4, b"", "Éa!! x".encode()])
    assert words.first[1] == 4 * len(cases.LONG.split()) - 3 and words.first[2] == words.first[1] and words.first[3] - words.first[2] == 3


# -- fingerprints --------------------------------------------------------------


def test_next_document_and_edit(spark):
    for docs in both(spark):
        pairs = sorted(texts_of(docs), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
        want = Counter()
        for (doc_id, text), (_, after) in zip(pairs, pairs[1:] + pairs[:1], strict=True):
            half = len(text) // 2
            changed = text[: len(text) - half] + after[:half]
            want[(doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), *fingerprints.digests([text.encode(), changed.encode()]))] += 1
        out = fingerprints.next_likeness(docs)
        got = out.collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        after = {d: t for (d, _), (_, t) in zip(pairs, pairs[1:] + pairs[:1], strict=True)}
        for r in got[:20]:
            if r["doc_id"] is not None and r["doc_id"] != 18:
                assert r["near_next"] == fingerprints.likeness([r["fingerprint"]], fingerprints.digests([after[r["doc_id"]].encode()]))[0]
    assert fingerprints.next_likeness(cases.empty(spark)).collect() == []


def test_only_document_follows_itself(spark):
    got = fingerprints.next_likeness(cases.documents(spark, [(1, "abcdef")])).collect()
    assert len(got) == 1 and got[0]["near_next"] == 1 and got[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def plain_digest(raw: bytes) -> str:
    """The digest by its definition, one triplet after another."""
    counts = [0] * 128
    for i in range(len(raw) - 4):
        for salt, (j, k) in enumerate([(1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4)]):
            triplet = raw[i] + 256 * raw[i + j] + 65536 * raw[i + k] + salt * 2**24
            counts[triplet * 0x9E3779B1 % 2**32 // 2**25] += 1
    q1, q2, q3 = (sorted(counts)[32 * k - 1] for k in (1, 2, 3))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    body = [sum(codes[4 * b + i] * 4**i for i in range(4)) for b in range(32)]
    length = min(255, math.floor(8 * math.log2(len(raw) + 1)))
    return bytes([length, (q1 * 15 // max(q3, 1)) * 16 + q2 * 15 // max(q3, 1), *body]).hex()


def plain_likeness(a: str, b: str) -> float:
    one, two = bytes.fromhex(a), bytes.fromhex(b)
    far = abs(one[0] - two[0]) + abs(one[1] // 16 - two[1] // 16) + abs(one[1] % 16 - two[1] % 16)
    for x, y in zip(one[2:], two[2:], strict=True):
        for i in range(4):
            step = abs(x // 4**i % 4 - y // 4**i % 4)
            far += 6 if step == 3 else step
    return max(0.0, 1 - far / 192)


def test_digests_by_their_definition(spark):
    docs = [(i, t) for i, t in cases.DOCUMENTS if t is None or len(t) < 6000]
    docs = [*docs, *((1000 + k, r["text"]) for k, r in enumerate(cases.sample(spark).limit(40).collect()))]
    pairs = sorted(((i, t or "") for i, t in docs), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    want = Counter()
    for (doc_id, text), (_, after) in zip(pairs, pairs[1:] + pairs[:1], strict=True):
        half = len(text) // 2
        own, new, following = (plain_digest(t.encode()) for t in (text, text[: len(text) - half] + after[:half], after))
        want[(doc_id, own, new, round(plain_likeness(own, new), 12), round(plain_likeness(own, following), 12))] += 1
    got = fingerprints.next_likeness(cases.documents(spark, docs)).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in got) == want


def test_bucket_counts_do_not_depend_on_batches():
    texts = [cases.LONG.encode(), b"", b"abcd", b"abcde", "日本語のテキスト".encode()] * 2
    together = fingerprints.bucket_counts(texts)
    assert (together == np.concatenate([fingerprints.bucket_counts([t]) for t in texts])).all()
    assert together[3].sum() == 6 and together[2].sum() == 0
    assert fingerprints.likeness(["00" * 34], ["00" * 34])[0] == 1


# -- byte-level BPE ------------------------------------------------------------


@pytest.fixture(scope="module")
def own():
    with open(BYTE_BPE, "rb") as lines:
        ranks = bpe.read_ranks(lines)
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(spark, own):
    for docs in both(spark):
        want = Counter()
        for doc_id, text in texts_of(docs):
            ids = own[1].encode_ordinary(text)
            want[(doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
        assert Counter(rows_of(bpe.round_trip(docs, BYTE_BPE, public_tokenizers.PATTERN))) == want
        assert Counter(rows_of(bpe.round_trip(docs, BYTE_BPE, public_tokenizers.PATTERN, leaf=50))) == want
    assert rows_of(bpe.round_trip(cases.empty(spark), BYTE_BPE, public_tokenizers.PATTERN)) == []
    decoded = bpe.decode_documents(bpe.encode_documents(docs, BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE, public_tokenizers.PATTERN)
    assert {(r["doc_id"], bytes(r["raw"]).decode()) for r in decoded.collect()} == set(texts_of(docs))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aé1 '\n\trestvlmd.!日   "), max_size=80), st.integers(4, 12), st.integers(1, 8))
def test_joins_equal_the_whole(own, text, leaf, window):
    codec = bpe.codec(BYTE_BPE, public_tokenizers.PATTERN)
    codec.leaf, codec.window = leaf, window
    assert codec.encode(text) == own[1].encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()
