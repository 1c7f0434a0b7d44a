"""Each operator against a brute-force version, on fixtures with nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from glyphmill.llm import arrow, bpe, bpe_text, decontamination, graph, jaccard_join, pieces, quality, shared, sharding, substring_dedup, token_counts, token_files, toxicity, warc, words
from glyphmill.llm.shared import fresh_folder, join_split, written

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RND = random.Random(7)
VOCAB = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 7))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + ("." if r.random() < 0.1 else "") for _ in range(n))


def edited(text: str, every: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) if i % every == every - 1 else w for i, w in enumerate(text.split()))


def fixture() -> list[tuple]:
    base, long_ = prose(120, 1), prose(9000, 2)
    passage = prose(70, 3)
    rows = [(None, prose(30, 4)), (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "one two"), (6, "One TWO"), (7, base), (8, base), (9, edited(base, 60, 5)), (10, edited(base, 9, 6)), (11, edited(base, 40, 7))]
    rows += [(12, long_), (13, prose(40, 8) + " " + passage + " " + prose(40, 9)), (14, passage + " " + prose(30, 10)), (15, prose(20, 11) + "\n" + passage), (7, base), (16, "x" * 30000), (17, "é\xa0\n\nb <|endoftext|> 'll 12345 日本語"), (18, "a b c d e f g h " * 30)]
    rows += [(100 + i, edited(prose(60, 50), 30, 200 + i)) for i in range(12)]
    rows += [(200 + i, prose(25, 300 + i) + " " + prose(12, 99) + " " + prose(25, 400 + i)) for i in range(10)]
    return rows


ROWS = fixture()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def clash(spark):
    """More columns, some named like results."""
    return spark.createDataFrame([(i or 0, t, "old", 5) for i, t in ROWS], "doc_id long, text string, n_tokens string, source int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def odd(spark):
    """Names that operators might use themselves."""
    names = "id key tk text2 hot way root sig n h own part shard _key __text".split()
    return spark.createDataFrame([(i or 0, t, *range(len(names))) for i, t in ROWS], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))


def split(text):
    return (text or "").encode().split()


# ---------------------------------------------------------------- what operators share


def test_join_split_deals_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
    counts = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k < 2000"), "counts")
    out = join_split(rows, counts, ["k"], way="way")
    assert sorted((r["k"], r["v"]) for r in out.collect()) == sorted((r["k"], r["v"]) for r in rows.where("k < 2000").collect())
    assert out.where("hot").select("way").distinct().count() > 50 and {r["k"] for r in out.where("hot").collect()} == {7}
    assert join_split(rows, counts, ["k"], how="left").count() == 3000


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master, applicationId = "spark://somewhere:7077", "x"

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        shared.shared_root(Session())


@pytest.mark.parametrize("operator", [substring_dedup.repeats, lambda df: token_files.write(df, "/nowhere", BYTE)])
def test_keys_that_are_no_whole_numbers_are_refused(spark, operator):
    with pytest.raises(ValueError):
        operator(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# ---------------------------------------------------------------- words


def test_scan_finds_words_and_windows():
    import pyarrow as pa

    texts = [t for _, t in ROWS]
    at = 0
    for scan in words.scans(pa.array(texts), slice_bytes=4000):
        hashes = scan.hashes()
        starts, grams = scan.windows(hashes, 3)
        seen = {}
        for d in range(scan.last - scan.first):
            a, b = scan.bounds[d], scan.bounds[d + 1]
            own = [bytes(scan.data[x:y]) for x, y in zip(scan.starts[a:b], scan.ends[a:b])]
            assert own == split(texts[scan.first + d])
            for s, g in zip(starts, grams):
                if a <= s < b:
                    assert seen.setdefault(int(g), tuple(own[s - a : s - a + 3])) == tuple(own[s - a : s - a + 3])
        at = scan.last
    assert at == len(texts)


# ---------------------------------------------------------------- 1 sharding


def test_a_task_alone_holds_nothing_of_other_operators():
    path = public_tokenizers.path("word_bpe_49k.json")
    before = bpe_text._decoder(path)
    assert bpe_text._decoder(path) is before
    assert list(arrow.alone(lambda batches: (b for b in batches))([1, 2])) == [1, 2]
    assert bpe_text._decoder.cache_info().currsize == 0 and bpe_text._units.cache_info().currsize == 0
    assert bpe_text._decoder(path) is not before


def test_what_making_held_things_took_is_given_back(monkeypatch):
    given = []
    monkeypatch.setattr(arrow, "give_back", lambda: given.append(1))
    made = arrow.held(lambda x: [x])
    assert made(1) is made(1) and given == [1]
    arrow._held.remove(made)


def test_parts_are_few_rows_and_all_of_them():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 3, 1203)]
    out = list(arrow.parts(iter(batches)))
    assert max(b.num_rows for b in out) == 500
    assert [x for b in out for x in b.column(0).to_pylist()] == [*range(3), *range(1203)]


def test_tasks_of_repeats_and_of_decontamination_are_alone(spark, monkeypatch):
    tasks, plain = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, run, *more, **named: (tasks.append(run.__qualname__), plain(df, run, *more, **named))[1])
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "z " + text), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs).collect()} == {1: text, 2: "z", 3: None}
    assert [r["doc_id"] for r in decontamination.without_contaminated(docs, bench).collect()] == [3]
    assert len(decontamination.contaminated(docs, bench).collect()) == 2
    assert len(tasks) == 7 and all(t.startswith("alone.") for t in tasks)


def test_units_remembered_take_twenty_bytes_and_their_ids():
    units = bpe_text._units.__wrapped__(public_tokenizers.path("word_bpe_49k.json"), True)
    import pyarrow as pa

    assert [flat.tolist() for _, _, flat, _ in units(pa.array(["one two one"]))] == [flat.tolist() for _, _, flat, _ in units(pa.array(["one two one"]))]
    assert sum(a.itemsize for a in (units.keys, units.rows, units.at, units.count)) == 20


def test_powers_hold_little_more_than_asked_for():
    powers = words._Powers(3)
    for n in (1, 2, 1000, (1 << 20) + 1):
        up, down = powers.upto(n)
        assert len(up) == len(down) == n and len(powers.up) <= 1.2 * n + 8
        assert ((up * down) == 1).all()


def test_sharding_law_and_ring(spark, docs, empty):
    rows = sharding.shard(docs, 4, vnodes=8).collect()
    assert len(rows) == len(ROWS)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard(empty, 4).count() == 0


def test_sharding_equals_a_walk_on_the_ring(spark):
    """Each key clockwise from its point to the first virtual node whose shard has room: own keys first, in ring order."""
    shards, vnodes = 5, 16
    rows = [(i, prose(3, i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = df.select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("c"))
    at = {r[0]: r[1] for r in sizes.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "c", "size"), 64 - sharding.RING_BITS)).collect()}
    ring = sharding.ring(shards, vnodes)
    cell = lambda p: p >> (sharding.RING_BITS - 14)
    arc_of = lambda p: next((k for k, (end, _) in enumerate(ring) if cell(p) <= end), 0)
    order = sorted(at, key=lambda i: (cell(at[i]) <= ring[-1][0], at[i]))  # the arc over position 0 begins behind the last node
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    placed, waiting = {}, []
    for i in order:
        k = arc_of(at[i])
        if room[ring[k][1]]:
            room[ring[k][1]] -= 1
            placed[i] = ring[k][1]
        else:
            waiting.append(i)
    walking = []
    for step in range(3 * len(ring)):
        k = step % len(ring)
        while walking and room[ring[k][1]]:
            room[ring[k][1]] -= 1
            placed[walking.pop(0)] = ring[k][1]
        if step < len(ring):
            walking += [i for i in waiting if arc_of(at[i]) == k]
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(df, shards, vnodes=vnodes).collect()} == placed


def test_sharding_moves_little_when_a_shard_is_added(spark):
    df = spark.createDataFrame([(i, prose(3, i)) for i in range(4000)], "doc_id long, text string")
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.shard(df, n).collect()} for n in (16, 17))
    moved = [i for i in before if before[i] != after[i]]
    assert len(moved) < 0.16 * len(before) and sum(after[i] != 16 for i in moved) < 0.1 * len(before)


def test_sharding_of_other_columns_and_long_texts(spark, odd):
    out = sharding.shard(odd, 4)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and out.count() == len(ROWS)
    one = sharding.shard(spark.createDataFrame([("k", "x" * 3_000_000)], "doc_id string, text string"), 2).collect()
    assert [(r["doc_id"], r["size"]) for r in one] == [("k", 3_000_001)]


def test_sharding_repeated_row(spark):
    hot = spark.range(10000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    counts = [r["count"] for r in sharding.shard(hot, 3).groupBy("shard").count().collect()]
    assert sorted(counts) == [3333, 3333, 3334]


def test_overflow_walks_clockwise():
    plan = sharding.overflow_plan([5, 0, 1], [0, 1, 2], [2, 2, 2])
    assert plan == [(0, 0, 2, 0, 0), (2, 0, 1, 2, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 1)]
    moved = sharding.overflow_plan([4, 4, 4], [0, 1, 2], [4, 4, 4])
    assert all(arc == shard for arc, _, _, shard, _ in moved)


def test_sharding_has_no_python(spark, docs):
    plan = sharding.shard(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[-1])


# ---------------------------------------------------------------- 2 quality


def test_quality_measures(docs, empty):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.line_quality(docs).collect()}
    want = set()
    for i, t in ROWS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {x for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for x in range(j, j + 8)}
        want.add((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert got == want
    assert quality.line_quality(empty).count() == 0


def test_quality_lines(spark):
    good = "This is a sentence with a good number of words, and it ends well."
    rows = [(1, "\n".join([good] * 1 + ["Another fine line of plain prose that is here to be kept."])), (2, "Home | News | Sport | Money | Contact\n" + "a | b | c | d | e | f | g | h | i | j | k | l | m | n | o | p | q | r | s | t"), (3, good + "\nAll rights reserved.\n" + good.replace("good", "fair"))]
    out = {r["doc_id"]: r for r in quality.line_quality(spark.createDataFrame(rows, "doc_id int, text string"), cleaned="clean").collect()}
    assert out[1]["kept"] and not out[2]["kept"] and out[3]["kept"]
    assert "reserved" not in out[3]["clean"] and good in out[3]["clean"]


def brute_kept(text):
    """The rules of the docstring, line by line."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    covered = {x for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for x in range(j, j + 8)}
    lost = 0
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            continue
        chars = sum(map(len, words))

        def ends(word):
            for _ in range(2):
                if len(word) > 1 and word[-1] in "\"')]":
                    word = word[:-1]
            return word[-1] in ".!?…。！？"

        noise = sum(33 <= ord(c) < 127 and not c.isalnum() for c in line)
        bars = sum(c in "|>»·•" for c in line)
        low = "".join(c.lower() if c.isascii() else c for c in line)
        phrase = len(words) <= 30 and any(p in low for p in quality.BOILERPLATE)
        if not any(map(ends, words)) or (len(words) >= 5 and noise > 0.15 * chars) or (bars >= 3 and len(words) <= 5 * bars) or phrase:
            lost += chars
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return not base and lost <= 0.5 * sum(map(len, w))


def test_quality_verdicts_equal_brute_force(spark, odd):
    r = random.Random(12)
    kinds = [
        lambda i: prose(r.randint(1, 30), i) + r.choice([".", "!", "", "”", '."', ".')"]),
        lambda i: " | ".join(prose(r.randint(1, 6), i + j) for j in range(r.randint(2, 6))),
        lambda i: prose(12, i) + " " + r.choice(quality.BOILERPLATE).upper() + r.choice(["", "."]),
        lambda i: "$$ ## " * r.randint(1, 5) + prose(5, i) + ".",
        lambda i: "句子。" * r.randint(1, 9) + r.choice(["»", " · ", "…"]),
        lambda i: " \t",
    ]
    rows = [(k, "\n".join(r.choice(kinds)(100 * k + j) for j in range(r.randint(1, 9)))) for k in range(400)]
    found = {x["doc_id"]: x["kept"] for x in quality.line_quality(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    want = {k: brute_kept(t) for k, t in rows}
    assert found == want and 40 < sum(want.values()) < 360
    assert quality.line_quality(odd).columns == [c for c in odd.columns if c != "n_words"] + [n for n, _ in quality.FIELDS]


# ---------------------------------------------------------------- 3, 10 tokens


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_transducer_equals_library(path):
    model, library = bpe.BpeModel(path, window=50), tokenizers.Tokenizer.from_file(path)
    r = random.Random(3)
    many = ["".join(r.choice("thein") for _ in range(r.choice([1, 3, 20, 700, 2000]))) for _ in range(60)]  # side by side
    ids, counts = model.encode_words([w.encode() for w in many])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(w, add_special_tokens=False).ids for w in many]
    for letters in ("a", "ab", "thein", "eron", "=-", "é", "aàá", "abcdefghijklmnopqrstuvwxyz"):
        for n in (1, 2, 30, 900):
            word = "".join(r.choice(letters) for _ in range(n))
            assert list(model.stream(word.encode())) == library.encode(word, add_special_tokens=False).ids
    assert model.lookahead < 400


@pytest.mark.parametrize("path, by_word", [(BYTE, False), (WORD, True)])
def test_encode_decode(docs, clash, empty, path, by_word):
    library = tokenizers.Tokenizer.from_file(path)
    rows = bpe_text.decode(bpe_text.encode(docs, path, words=by_word), path).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    digests = bpe_text.round_trip(clash, path, words=by_word)
    assert digests.columns == ["doc_id", "text", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in digests.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_text.round_trip(empty, path).count() == 0


def test_decoder_invalid_bytes():
    library, decoder = tokenizers.Tokenizer.from_file(BYTE), bpe_text.Decoder(BYTE)
    r = random.Random(1)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))] + [r.choice([162, 223, 96, 105])]
        assert decoder.text(ids) == library.decode(ids, skip_special_tokens=False)


def test_token_counts(docs, empty):
    library = tokenizers.Tokenizer.from_file(BYTE)
    for r in token_counts.token_counts(docs, BYTE, limit=20).collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 20)
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_prefix_counts_and_truncation():
    library = tokenizers.Tokenizer.from_file(BYTE)
    counter, split_ = token_counts.PrefixCounter(BYTE), pieces.Splitter(library, words=False)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in ("It's  a\n\n test of don't  ", "aaaa'll bbb   ", "日本語 é x", "12345 -- ===="):
        table = token_counts.PrefixCounts(counter, split_, text)
        assert [table.count(n) for n in range(len(text) + 1)] == [count(text[:n]) for n in range(len(text) + 1)]
        counts = [count(text[:n]) for n in range(len(text) + 1)]
        assert table.all().tolist() == counts
        for budget in range(count(text) + 2):
            longest = max(n for n, c in enumerate(counts) if c <= budget)
            assert table.truncate(budget) == (text[:longest], counts[longest])


def test_prefix_columns(spark, clash, odd):
    library = tokenizers.Tokenizer.from_file(BYTE)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = [(1, "It's  a\n\n test"), (2, None), (None, "'llx  \n é日"), (3, "aaaa" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in token_counts.prefix_tokens(df, BYTE).collect():
        t = r["text"] or ""
        assert r["prefix_tokens"] == [count(t[:n]) for n in range(len(t) + 1)]
    for budget in (0, 1, 3, 5):
        for r in token_counts.truncated(df, BYTE, budget).collect():
            t = r["text"] or ""
            longest = max(n for n in range(len(t) + 1) if count(t[:n]) <= budget)
            assert (r["truncated"], r["n_tokens"]) == (t[:longest], count(t[:longest]))
    assert token_counts.truncated(clash, BYTE, 5).columns == ["doc_id", "text", "source", "truncated", "n_tokens"]
    assert token_counts.token_counts(clash, BYTE).columns == ["doc_id", "text", "source", "n_bytes", "n_tokens", "over_limit"]
    with pytest.raises(ValueError):
        token_counts.truncated(df, BYTE, -1)


# ---------------------------------------------------------------- 4 decontamination


def brute_tiles(a, b, least):
    """Every longest match found by comparing all starts, again and again."""
    used_a, used_b, out = set(), set(), 0
    while True:
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        if best < least:
            return out
        used_a |= set(range(at[0], at[0] + best))
        used_b |= set(range(at[1], at[1] + best))
        out += best


def test_tiling_equals_brute_force():
    r = random.Random(5)
    for _ in range(60):
        a, b = [r.randint(1, 4) for _ in range(r.randint(0, 30))], [r.randint(1, 4) for _ in range(r.randint(1, 20))]
        tiles = decontamination.tiles(a, b, 3)
        assert all(a[d : d + n] == b[i : i + n] for d, i, n in tiles)
        assert len({x for d, _, n in tiles for x in range(d, d + n)}) == sum(n for _, _, n in tiles)
        assert sum(n for _, _, n in tiles) == brute_tiles(a, b, 3)


def test_decontamination(spark, empty):
    item, other = prose(24, 70), prose(24, 71)
    parts = item.split()
    moved = " ".join(parts[12:] + ["zz", "yy"] + parts[:12])
    rows = [(1, prose(50, 72) + " " + item.upper() + "! " + prose(30, 73)), (2, prose(60, 74)), (3, prose(20, 75) + " " + moved), (4, None), (5, ""), (6, " ".join(parts[:6]) + " " + prose(40, 76)), (1, other)]
    bench = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "")], "item_id int, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()} == {(1, 10), (3, 10), (1, 11)}
    assert sorted(r["doc_id"] for r in decontamination.without_contaminated(docs, bench).collect()) == [2, 4, 5, 6]
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_other_columns_and_long_texts(spark, odd, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    item = prose(20, 70)
    bench = spark.createDataFrame([(None, item), (2, prose(20, 71)), (2, item), (3, prose(20, 73))], "item_id int, text string")
    docs = spark.createDataFrame([(None, prose(40000, 1) + " " + item), (1, prose(30, 2)), (1, prose(30, 2))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in decontamination.contaminated(docs, bench).collect()) == [(None, 0), (None, 2)]
    assert [r["doc_id"] for r in decontamination.without_contaminated(docs, bench).collect()] == [1, 1]
    out = decontamination.without_contaminated(odd, bench)
    assert out.columns == odd.columns and out.count() == len(ROWS)


def test_decontamination_by_short_runs():
    item = prose(9, 80).split()
    long_item = prose(24, 81).split()
    blocks = [long_item[i : i + 4] for i in range(0, 24, 4)]
    block = decontamination.Block([(1, " ".join(item)), (2, " ".join(long_item)), (3, "qa qb qc qd"), (4, "ra rb")])
    found = lambda text: [(k, round(c, 3)) for k, c, _ in block.search(text)]
    assert found(" ".join([*item[:4], "zz", *item[5:]])) == [(1, 0.889)]
    assert found(" zz ".join(" ".join(b) for b in reversed(blocks))) == [(2, 1.0)]
    assert found("zz qa qb qc zz qd") == [(3, 0.75)]
    assert found("qa qb zz qc qd ra zz rb") == []
    assert found("zz ra rb") == [(4, 1.0)]


def test_decontamination_finds_what_tiles_cover():
    r = random.Random(6)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    items = [(k, text(r.randint(1, 14))) for k in range(40)]
    block = decontamination.Block(items)
    for _ in range(60):
        document = text(r.randint(0, 40))
        wanted = {}
        for k, item in items:
            a, b = [ord(w) for w in document.split()], [ord(w) for w in item.split()]
            n = sum(t[2] for t in decontamination.tiles(a, b, min(decontamination.LEAST, len(b))))
            if n / len(b) >= decontamination.COVERAGE:
                wanted[k] = n / len(b)
        assert {k: c for k, c, _ in block.search(document)} == wanted


def test_benchmark_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    items = [(i, prose(20, 500 + i)) for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    assert {(r[0], r[1]) for r in decontamination.contaminated(docs, bench).select("doc_id", "item_id").collect()} == {(i, i) for i in range(5)}


# ---------------------------------------------------------------- 5 jaccard


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    group = defaultdict(list)
    for a in range(len(sets)):
        group[find(a)].append(sets[a][0])
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in group.items()}
    return Counter((sets[a][0], len(sets[a][1]), least[find(a)]) for a in range(len(sets)))


def test_near_duplicates(docs, empty):
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert found == brute_components(ROWS)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_near_duplicates_dense_group(spark):
    """Many copies with edits, some of them linked only through others, and strangers that share a passage."""
    base, shared = prose(130, 900), prose(40, 901)
    rows = [(i, edited(base, RND.choice([25, 45, 70, 200]), 1000 + i)) for i in range(120)] + [(500 + i, prose(8, 2000 + i) + " " + shared + " " + prose(8, 3000 + i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert found == brute_components(rows)


def test_near_duplicates_when_signatures_collide(spark, docs, monkeypatch):
    true = jaccard_join._signature
    monkeypatch.setattr(jaccard_join, "_signature", lambda s, salt: len(s) % 3 if salt == 0 else true(s, salt))
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert found == brute_components(ROWS)


def test_near_duplicates_with_hot_elements(spark):
    """Pairs of copies, all of which hold one passage."""
    passage = prose(60, 901)
    rows = []
    for i in range(150):
        own = prose(40, 7000 + i)
        rows += [(2 * i, own + " " + passage), (2 * i + 1, edited(own, 35, i) + " " + passage)]
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == brute_components(rows)


def test_strangers_that_share_a_passage_are_not_paired(spark):
    """10,000 unlinked texts that share one element meet nowhere: none has enough others."""
    rows = spark.range(10000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one passage of five words"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.md5(F.concat(F.col("id").cast("string"), F.lit("/"), k.cast("string")))).cast("string")).alias("text"))
    rows = rows.withColumn("text", F.translate("text", ",[]", ""))
    out = jaccard_join.near_duplicates(rows)
    assert out.where("component_id = doc_id").count() == 10000


def test_near_duplicates_of_other_columns_and_text_keys(spark, odd):
    assert jaccard_join.without_near_duplicates(odd).columns == odd.columns
    found = jaccard_join.near_duplicates(spark.createDataFrame([("b", prose(30, 1)), ("a", prose(30, 1)), ("c", "x" * 100000)], "doc_id string, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_shingle_sets_of_any_slices(monkeypatch):
    column = pa.array(["a b c d e f g", None, "", "x y", "p q r s t " * 400, "A b c d e f g"])
    whole = [s.tolist() for s in jaccard_join.shingle_sets(column)]
    monkeypatch.setattr(jaccard_join, "_SLICE_BYTES", 16)
    assert [s.tolist() for s in jaccard_join.shingle_sets(column)] == whole and whole[0] == whole[5] and len(whole[4]) == 5


def test_one_of_each_group_stays(docs, clash):
    kept = jaccard_join.without_near_duplicates(docs).collect()
    want = brute_components(ROWS)
    assert sorted(r["doc_id"] for r in kept if (r["text"] or "").split() and r["doc_id"] is not None) == sorted({c for _, n, c in want if n and c is not None})
    assert {r["doc_id"] for r in kept} >= {1, 2, 3}
    assert jaccard_join.without_near_duplicates(clash).columns == clash.columns


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 9), (20, 20)]
    out = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[n] for n in (1, 2, 3, 9)} == {out[1]} and out[10] == out[11] != out[1]


# ---------------------------------------------------------------- 6 toxicity


def test_toxicity(spark, empty):
    bad = ["idiotic", "moronish", "scummy", "trashy"]
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = prose(60, 5000 + i).split()
        if toxic:
            for _ in range(5):
                w[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), 1))
    docs = spark.createDataFrame([*rows, (9001, None), (9002, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (9001, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, known)
    out = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(out[i]["predicted"] == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.95
    assert all(0 <= x["score"] <= 1 for x in out.values()) and out[9001]["predicted"] == 0 == out[9002]["predicted"]
    assert toxicity.score(empty, model).count() == 0
    one = toxicity.train(docs, known.where("toxic = 0"))
    assert {x["score"] for x in toxicity.score(docs, one).collect()} == {0.0}


def test_rows_that_stay_are_handed_back_by_the_few(monkeypatch):
    class Frame:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    monkeypatch.setattr(toxicity, "_ROWS", 7)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(20), "text": ["one two"] * 20})
    out = list(toxicity.without_toxic(Frame(), toxicity.Model())(iter([batch])))
    assert [b.num_rows for b in out] == [7, 7, 6] and pa.Table.from_batches(out).equals(pa.Table.from_batches([batch]))


def test_toxicity_by_language(spark):
    """Held-out labelled rows of sf0.1, learned from the others: recall and precision overall and by language."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(F.broadcast(labels), "doc_id").select("doc_id", "text", "lang", "toxic")
    model = toxicity.train(docs, labels)
    seen = Counter()
    for r in toxicity.score(known.where(toxicity.is_held_out("doc_id")), model).select("lang", "toxic", "predicted").collect():
        for lang in (r["lang"], "all"):
            seen[lang, r["toxic"], r["predicted"]] += 1
    for lang, least in (("all", 0.9), ("en", 0.85), ("de", 0.85), ("es", 0.85), ("fr", 0.85)):
        caught, missed, wrong = seen[lang, 1, 1], seen[lang, 1, 0], seen[lang, 0, 1]
        assert caught >= least * (caught + missed) and caught >= least * (caught + wrong), (lang, caught, missed, wrong)


def test_toxicity_dictionaries_see_their_own_texts():
    texts = [f"{prose(10, 8000 + i)} {['zorgish', 'quaxle', '', ''][i % 4]} {prose(10, 9000 + i)}" for i in range(240)]
    model = toxicity.fit(texts, [int(i % 4 < 2) for i in range(240)]).measure()
    shown = toxicity.placed(b" zorgish ")
    assert shown in model.toxic and shown not in model.ordinary
    assert model.gains("zorgish")[0] > max(toxicity.STEPS) > model.gains(VOCAB[0])[0]
    assert model.score("zorgish " * 3 + prose(20, 1)) >= toxicity.REJECT > model.score(prose(20, 1))


def test_toxicity_columns_ties_and_long_texts(spark, clash):
    model = toxicity.fit([f"{prose(20, i)} {'zorgish' if i % 2 else ''} {prose(3, 500 + i)}" for i in range(120)], [i % 2 for i in range(120)])
    rows = [(1, "zorgish " * 50000, 0.5, "a"), (2, "zorgish zorgish zorgish", 0.5, "b"), (2, "zorgish zorgish zorgish", 0.5, "b"), (None, None, None, None), (3, "x" * 200000, 1.0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    kept = toxicity.without_toxic(df, model).collect()
    assert {(r["doc_id"], r["score"], r["predicted"]) for r in kept} == {(None, None, None), (3, 1.0, "c")}
    scored = toxicity.score(df, model)
    assert scored.columns == ["doc_id", "text", "score", "predicted"]
    assert len({r["score"] for r in scored.where("doc_id = 2").collect()}) == 1
    assert toxicity.score(clash, model).columns == [*clash.columns, "score", "predicted"]


# ---------------------------------------------------------------- 7 substring dedup


def brute_repeats(rows, window=50):
    key = lambda i: 2**63 if i is None else i
    first = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            first[g] = min(first.get(g, 2**63), key(i))
    out = []
    for i, t in rows:
        w = split(t)
        gone = {x for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < key(i) for x in range(j, j + window)}
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def test_repeats(docs, empty):
    found = Counter(tuple(r) for r in substring_dedup.repeats(docs).collect())
    assert found == brute_repeats(ROWS)
    assert substring_dedup.repeats(empty).count() == 0


def test_repeats_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "STREAM_BYTES", 3000)
    base = prose(300, 77)
    rows = [(i, " ".join(edited(base, 110 + i, 60 + i).split()[i * 5 : 200 + i * 3])) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in substring_dedup.repeats(docs).collect()) == brute_repeats(rows)


def test_repeats_with_hot_windows_and_extreme_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    passage, base = prose(70, 3), prose(80, 4)
    rows = [(k, prose(20, i) + " " + passage + " " + prose(20, 100 + i)) for i, k in enumerate([2**63 - 1, -(2**63), 0, 5, 9, 12, 30, 31, 40])]
    rows += [(i, base) for i in range(60, 75)] + [(7, base), (7, base), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in substring_dedup.repeats(df).collect()) == brute_repeats(rows)
    cut = substring_dedup.without_repeats(df).collect()
    assert Counter((r["doc_id"], hashlib.sha256(b" ".join(split(r["text"]))).hexdigest()) for r in cut) == Counter({(i, sha): n for (i, _, _, sha), n in brute_repeats(rows).items()})


def test_without_repeats_of_other_columns(odd):
    out = substring_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS)


def test_without_repeats(docs, clash):
    want = {(i, n, cut): sha for (i, n, cut, sha) in brute_repeats(ROWS)}
    digest = Counter((i, sha) for (i, _, _), sha in want.items())
    rows = substring_dedup.without_repeats(docs).collect()
    assert Counter(set((r["doc_id"], hashlib.sha256(b" ".join(split(r["text"]))).hexdigest()) for r in rows)) == digest
    assert substring_dedup.without_repeats(clash).columns == clash.columns


# ---------------------------------------------------------------- 8 token files


def test_simple_8b():
    r = np.random.default_rng(0)
    for k in range(200):
        ids = r.integers(0, 2 ** int(r.integers(1, 62)), int(r.integers(0, 400)), dtype=np.int64)
        if k % 3 == 0 and len(ids):
            ids[r.integers(0, len(ids), 3)] = 2**62 - 1
        packed, escaped = token_files.pack(ids)
        assert (token_files.unpack(packed, escaped, len(ids)).astype(np.int64) == ids).all()
    small, _ = token_files.pack(np.full(1000, 3))
    assert len(small) == 34  # thirty ids of two bits in each word
    with pytest.raises(ValueError):
        list(token_files.blocks(b"nothing of the kind"))


def test_blocks_by_footer(spark):
    texts = spark.createDataFrame([(i, prose(30_000, 900 + i)) for i in range(12)], "doc_id long, text string")
    listing = token_files.write(texts, fresh_folder(spark, "t"), BYTE).collect()
    most = 0
    for row in listing:
        data = token_files.files.load(row["file"])
        offsets, firsts = token_files.index_of(data)
        ids = np.concatenate([b[2] for b in token_files.blocks(data)])
        _, lengths, last = token_files.block_at(data, int(offsets[-1]))
        assert len(ids) == row["ids"] == firsts[-1] + lengths.sum()
        assert (last == ids[firsts[-1] :]).all()
        most = max(most, len(offsets))
    assert most > 1


def test_token_files_of_extreme_keys_and_other_columns(spark, odd):
    rows = [(-(2**63), "a"), (None, "b"), (2**63 - 1, None), (None, "b"), (0, "x" * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = token_files.read(written(token_files.write(df, fresh_folder(spark, "t"), BYTE), "listing")).collect()
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])] == [None, None, -(2**63), 0, 2**63 - 1]
    listing = written(token_files.write(odd, fresh_folder(spark, "t"), BYTE), "listing")
    assert token_files.read(listing).count() == len(ROWS)


def test_token_files(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    listing = written(token_files.write(docs, fresh_folder(spark, "t"), BYTE), "listing")
    rows = token_files.read(listing).collect()
    library = tokenizers.Tokenizer.from_file(BYTE)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want, at = [], 0
    for i, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert Counter(tuple(r) for r in rows) == Counter(want)
    assert token_files.read(written(token_files.write(empty, fresh_folder(spark, "t"), BYTE), "listing")).count() == 0


# ---------------------------------------------------------------- 9 archives

PAGES = [(5, "http://a.example/ x", "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"), (9, None, None), (3, "http://c.example/", ""), (7, "http://d.example/", "é" * 5000), (None, "http://e.example/", "alone"), (2, "http://b.example/", "<p>same</p>")]


@pytest.mark.parametrize("least", [0, 1, 10**6])
def test_archive(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.archive(df, least_bytes=least).collect()
    assert len(rows) == len(PAGES)
    first = {}
    for k, _, h in PAGES:
        b = (h or "").encode()
        first[b] = min(first.get(b, 99), 99 if k is None else k)
    for r in rows:
        body = next((h or "").encode() for k, _, h in PAGES if k == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        if r["record_type"] == "revisit":
            assert len(body) >= least and r["refers_to"] == first[body]
        else:
            assert r["refers_to"] is None
    kinds = Counter((r["page_id"], r["record_type"]) for r in rows)
    if least == 0:
        assert kinds[2, "response"] == 1 and kinds[2, "revisit"] == 1 and kinds[5, "revisit"] == 1 and kinds[9, "revisit"] == 1 and kinds[3, "response"] == 1
    if least == 10**6:
        assert not [k for k in kinds if k[1] == "revisit"]
    assert warc.archive(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    arc = warc.ArcWriter("x.arc.gz", version, "20010203040506")
    arc.add("http://x.example/a b", "text/html", warc.http_block(b"hi\n\nthere", "4"))
    arc.add("http://y.example/", "text/html", warc.http_block(b"", None))
    got = list(warc.read_arc(arc.content()))
    assert [r.fields["URL"] for r in got] == ["http://x.example/a b", "http://y.example/"]
    (headers, block), = warc.read_warc(warc.convert("x.arc.gz", got[0], None))
    assert headers["warc-date"] == "2001-02-03T04:05:06Z" and headers["warc-type"] == "response"
    assert warc.split_http(block)[2] == b"hi\n\nthere"
    assert headers["warc-block-digest"] == "sha1:" + warc.sha1_base32(block)
    with pytest.raises(ValueError):
        list(warc.read_arc(b"filedesc://x 0.0.0.0 2001 text/plain 26\n9 0 who\nURL Archive-length\n\n"))


@pytest.mark.parametrize("version", [1, 2])
def test_records_of_real_archives(spark, version):
    """Short and impossible dates, heads of other bytes and line ends, and records that are no HTTP."""
    arc = warc.ArcWriter("y.arc.gz", version, "19970203040506")
    latin = b"HTTP/1.0 200 OK\nServer: caf\xe9\nX-Archive-Key: 8\n\n<p>\xe9</p>"
    arc.add("dns:www.x.example", "text/dns", b"19970101\nwww.x.example 86400 IN A 10.0.0.1\n", "19970101", "10.0.0.2")
    arc.add("http://x.example/a b", "text/html; charset=latin-1", latin, "199702", "10.0.0.1")
    arc.add("http://x.example/old", "text/html", b"<p>no head</p>", "0")
    arc.add("http://x.example/bad", "text/html", warc.http_block(b"x", "9 %\n"), "19971399000000")
    arc.add("http://x.example/nohead", "text/html", b"HTTP/1.1 204 No Content", "1997")
    found = list(warc.read_arc(arc.content()))
    assert [r.fields["URL"] for r in found] == ["dns:www.x.example", "http://x.example/a b", "http://x.example/old", "http://x.example/bad", "http://x.example/nohead"]
    assert found[1].fields["Content-type"] == "text/html; charset=latin-1" and found[1].fields["IP-address"] == "10.0.0.1"
    out = [next(warc.read_warc(warc.convert("y.arc.gz", r, None))) for r in found]
    assert [h["warc-date"] for h, _ in out] == ["1997-01-01T00:00:00Z", "1997-02-01T00:00:00Z", "1997-02-03T04:05:06Z", "1997-02-03T04:05:06Z", "1997-01-01T00:00:00Z"]
    assert [h["warc-type"] for h, _ in out] == ["resource", "response", "resource", "response", "response"]
    assert out[0][0]["content-type"] == "text/dns" and out[0][0]["warc-ip-address"] == "10.0.0.2"
    for (headers, block), record in zip(out, found):
        http, _, payload = warc.split_http(block)
        assert block == record.block and headers["warc-payload-digest"] == "sha1:" + warc.sha1_base32(payload)
        assert int(headers["x-payload-length"]) == len(payload)
    assert warc.split_http(out[1][1])[2] == b"<p>\xe9</p>" and warc.archive_key(warc.split_http(out[3][1])[0]) == "9 %\n"
    # the same records through the tables
    folder = fresh_folder(spark, "arc")
    listing = spark.createDataFrame([(warc.files.create(folder, arc.content(), ".arc.gz"),)], "file string")
    rows = warc.read_files(warc.convert_files(listing, fresh_folder(spark, "warc"), key_type="string"), key_type="string").collect()
    assert Counter((r["page_id"], r["record_type"]) for r in rows) == Counter({(None, "resource"): 2, ("8", "response"): 1, ("9 %\n", "response"): 1, (None, "response"): 1})


def test_archive_versions_dates_and_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    rows = [(f"k{i:02}", f"http://h{i}.example/", "same" if i % 2 else f"page {i}", f"2001010{1 + i % 9}000000") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, at string")
    for versions in ((1,), (2,), (1, 2)):
        out = {r["page_id"]: r for r in warc.archive(df, date=F.col("at"), versions=versions).collect()}
        assert len(out) == 40 and {r["refers_to"] for r in out.values()} == {None, "k01"}
        assert sum(r["record_type"] == "revisit" for r in out.values()) == 19
    listing = warc.write_arc(df, fresh_folder(spark, "arc"), date=F.col("at")).collect()
    kinds, dates = Counter(), set()
    for row in listing:
        data = warc.files.load(row["file"])
        kinds[__import__("gzip").decompress(data).split(b"\n")[1][:1]] += 1
        dates |= {r.fields["Archive-date"] for r in warc.read_arc(data)}
    assert set(kinds) == {b"1", b"2"} and dates == {r[3] for r in rows}


def test_archive_of_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "x", 1, 2, 3), (None, None, None, 1, 2, 3)], "page_id int, url string, html string, key int, digest int, refers_to int")
    assert Counter(r["page_id"] for r in warc.archive(df).collect()) == Counter([1, None])
