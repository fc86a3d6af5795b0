"""Exact dedup, SimHash near-dedup, sharding and packing: brute force, hand-made edge cases, properties."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from moodspark.llm import exact_dedup, packing, queries, sharding, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _block string, shard int, fp string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 7, "y") for i, t in rows], SCHEMA)


ODD = [(5, "Alpha beta"), (3, "alpha BETA"), (9, None), (8, ""), (8, ""), (None, "alpha beta"), (None, None),
       (11, "É"), (12, "é"), (13, "word " * 70_000), (14, "WORD " * 70_000)]


def upper_free(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups_on_odd_rows(spark):
    got = exact_dedup.exact_groups(frame(spark, ODD)).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[upper_free(t)].append(i)
    assert len(got) == len(ODD)
    for text, ids in groups.items():
        rows = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
        assert {r.group_size for r in rows} == {len(ids)}
        assert {r.keep_id for r in rows} == {max((i for i in ids if i is not None), default=None)}
        assert sum(r.kept for r in rows) == 1


def test_exact_groups_with_frequent_texts(spark):
    rows = [(i, "the same" if i % 3 == 0 else f"text {i % 400}") for i in range(6000)]
    got = exact_dedup.exact_groups(frame(spark, rows), heavy=5, counters=64).collect()
    size = Counter(t for _, t in rows)
    last = {t: i for i, t in rows}
    by = dict(rows)
    assert len(got) == 6000
    assert all(r.group_size == size[by[r.doc_id]] and r.keep_id == last[by[r.doc_id]]
               and r.kept == (r.doc_id == r.keep_id) for r in got)


def test_drop_copies_keeps_columns_and_winners(spark):
    docs = frame(spark, ODD)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect()) == [
        (5, "Alpha"), (9, ""), (11, "É"), (12, "é"), (14, "WORD ")]


@pytest.mark.parametrize("operator", [
    exact_dedup.exact_groups, exact_dedup.drop_copies, simhash.near_groups, simhash.drop_near_copies,
    sharding.assign_shards, lambda d: packing.pack(d, queries.tokenizer())])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def plain_simhash(text):
    words = [w for w in upper_free(text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ")
             .replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids_fps, max_bits):
    fps = sorted(set(fp for _, fp in ids_fps))
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= max_bits:
                up[root(a)] = root(b)
    least = {}
    for i, f in ids_fps:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((str(i), f, least.get(root(f))) for i, f in ids_fps), key=str)


def test_simhash_query_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    want = plain_components([(r.doc_id, plain_simhash(r.text)) for r in docs], 2)
    got = queries.op2(spark, SF).collect()
    assert sorted(((str(r.doc_id), int(r.fingerprint, 16), r.component_id) for r in got), key=str) == want


def test_simhash_odd_rows(spark):
    got = simhash.near_groups(frame(spark, ODD)).collect()
    want = plain_components([(i, plain_simhash(t)) for i, t in ODD], 2)
    assert sorted(((str(r.doc_id), r.fp % 2 ** 64, r.component_id) for r in got), key=str) == want
    kept = simhash.drop_near_copies(frame(spark, ODD)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 8, 11, 12, 13]


@pytest.mark.parametrize(("max_bits", "segments", "bucket"), [(2, 2, 64), (2, 2, 1), (1, 2, 1), (3, 2, 2), (2, 4, 64)])
def test_multi_index_links_against_brute_force(spark, max_bits, segments, bucket):
    draw = random.Random(7)
    fps = {draw.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:25]:        # chains and crowds around some of them
        for _ in range(6):
            f ^= sum(1 << b for b in draw.sample(range(64), draw.randint(1, max_bits + 1)))
            fps.add(f)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(f - 2 ** 64 if f >> 63 else f,) for _, f in rows], "fp bigint")
    edges = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in simhash.links(df, max_bits, segments, bucket).collect()]
    assert all((a ^ b).bit_count() <= max_bits for a, b in edges)
    from moodspark.llm.common import components
    roots = {r.node: r.root for r in components(simhash.links(df, max_bits, segments, bucket)).collect()}
    mine = defaultdict(set)
    for _, f in rows:
        s = f - 2 ** 64 if f >> 63 else f
        mine[roots.get(s, s)].add(f)
    want = defaultdict(set)
    for i, f, c in plain_components(rows, max_bits):
        want[c].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_sharding_query(spark):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = queries.op6(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_fill_evenly_and_move_only_into_changed_subtrees(spark):
    df = spark.range(40_000).withColumnRenamed("id", "key")
    for n in (40, 41, 42):
        df = sharding.with_shard(df, "key", n, f"s{n}")
    rows = df.collect()
    count = Counter(r.s40 for r in rows)
    assert set(count) == set(range(40)) and max(count.values()) < 1.2 * 1000 and min(count.values()) > 0.8 * 1000
    assert {r.s41 for r in rows if r.s41 != r.s40} == {40}
    assert {r.s42 for r in rows if r.s42 != r.s41} <= {40, 41}        # the last region's weight changed
    assert 0.8 < sum(r.s41 == 40 for r in rows) / (40_000 / 41) < 1.2


def test_sharding_odd_rows(spark):
    got = sharding.assign_shards(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id in (8, 9)} == {(16, 0)}
    assert len({r.shard for r in got if r.doc_id is None}) == 1


def packed(rows, texts, length=2048):
    """Every id in one piece; sequences gapless and within the length; returns ids by document order."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
    return sequences


def test_packing_query_round_trip(spark):
    import numpy as np
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(queries.tokenizer())
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()}
    rows = queries.op7(spark, SF).collect()
    sequences = packed(rows, docs)
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
    assert set(parts) == set(docs)
    for i, text in docs.items():
        ids = [*encoder.encode(text, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    assert total / (2048 * len(sequences)) > 0.97


def test_packing_odd_rows(spark):
    odd = [*ODD, (20, "a\x1cb \x1f c"), (21, "<|endoftext|>x y'll")]
    rows = packing.pack(frame(spark, odd), queries.tokenizer()).collect()
    packed(rows, odd)
    assert sum(r.start == 0 for r in rows) == len(odd)
    assert {r.doc_tokens for r in rows if r.doc_id in (8, 9)} == {1}
    from tokenizers import Tokenizer
    encoder = Tokenizer.from_file(queries.tokenizer())
    for i, t in odd[-2:]:
        assert [r.doc_tokens for r in rows if r.doc_id == i] == [len(encoder.encode(t, add_special_tokens=False).ids) + 1]


def test_shortest_pack_first_places_all():
    draw = random.Random(3)
    histogram = {n: draw.randint(0, 50) for n in range(1, 129)}
    patterns = packing.shortest_pack_first(histogram, 128)
    placed = Counter()
    for packs, lengths in patterns:
        assert sum(lengths) <= 128 and lengths == sorted(lengths, reverse=True)
        for n in lengths:
            placed[n] += packs
    assert placed == Counter({n: c for n, c in histogram.items() if c})
    assert packing.shortest_pack_first({3: 2, 5: 1}, 8) == [(1, [5, 3]), (1, [3])]
    with pytest.raises(ValueError):
        packing.shortest_pack_first({9: 1}, 8)


def test_kept_rows_keep_columns_with_clashing_names(spark):
    rows = [(1, "a b c d", "x", "x", "x", "x", "x"), (2, "A b c d", "x", "x", "x", "x", "x"), (3, "other words here", *["x"] * 5),
            (None, "other words here", *["x"] * 5), (None, "alone", *["x"] * 5), (None, "alone", *["x"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, sha string, none string, own string, region string")
    for kept, ids in ((exact_dedup.drop_copies(docs), [None, 2, 3]), (simhash.drop_near_copies(docs), [None, 1, 3])):
        got = kept.collect()
        assert kept.columns == docs.columns and sorted((r.doc_id for r in got), key=lambda i: (i is not None, i)) == ids
        assert all(r[2:] == ("x",) * 5 for r in got)
    placed = sharding.with_shard(docs.withColumn("rack", F.lit("x")), "doc_id", 40, "shard")
    assert placed.columns == [*docs.columns, "rack", "shard"] and all(r.region == r.rack == "x" for r in placed.collect())


def test_shards_equal_a_walk_down_the_tree(spark):
    """Each level's draws as rows of their own: every child of the chosen node, the smallest draw wins."""
    shards = 13
    layout = sharding.tree(shards)
    keys = spark.range(300).select(F.col("id").cast("string").alias("k"))
    at = [F.lit(None)] * 0
    chosen = keys.withColumn("path", F.array().cast("array<int>"))
    for level in range(3):
        nodes = []
        for r, region in enumerate(layout):
            if level == 0:
                nodes.append(([], r, sum(map(len, region))))
            for q, rack in enumerate(region):
                if level == 1:
                    nodes.append(([r], q, len(rack)))
                if level == 2:
                    nodes += [([r, q], i, 1) for i in range(len(rack))]
        children = spark.createDataFrame(nodes, "path array<int>, child int, weight int")
        at = [F.col("path")[i] for i in range(level)]
        bits = F.shiftrightunsigned(F.xxhash64("k", F.lit(level), *at, F.col("child")), 12)
        draw = -F.log((bits.cast("double") + 0.5) / F.lit(float(2 ** 52))) / F.col("weight")
        chosen = (chosen.join(children, "path").withColumn("draw", draw).groupBy("k", "path")
                  .agg(F.min_by("child", "draw").alias("child"))
                  .select("k", F.concat("path", F.array("child")).alias("path")))
    number = {(r, q, i): s for r, region in enumerate(layout) for q, rack in enumerate(region) for i, s in enumerate(rack)}
    want = {r.k: number[tuple(r.path)] for r in chosen.collect()}
    got = {r.k: r.shard for r in sharding.with_shard(keys, "k", shards, "shard").collect()}
    assert got == want and len(set(want.values())) == shards


def test_packing_equals_one_piece_at_a_time():
    """Shortest pack first by single pieces: each into the pack with the most room, if it fits, else a new one."""
    rng = random.Random(3)
    for length in (16, 128):
        sizes = sorted((rng.randint(1, length) for _ in range(400)), reverse=True)
        rooms: list[int] = []
        for s in sizes:
            most = max(rooms, default=-1)
            if most >= s:
                rooms[rooms.index(most)] -= s
            else:
                rooms.append(length - s)
        histogram = {s: sizes.count(s) for s in set(sizes)}
        patterns = packing.shortest_pack_first(histogram, length)
        assert sum(n for n, _ in patterns) == len(rooms)
        assert sorted(length - sum(p) for n, p in patterns for _ in range(n)) == sorted(rooms)


def test_words_of_a_tokenizer_are_whole_whatever_the_cache_holds():
    from tokenizers import Tokenizer

    with open(queries.tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    tokenizer, words, rng = Tokenizer.from_str(spec), packing.WordTokens(spec, 50), random.Random(4)
    parts = ["a", "B", "é", "É", "ß", "ſ", "ı", "İ", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", ".", "!!", "'s", "3", "12",
             "中", "🙂", "́", "K", "#", "Ω", "ĳ", "ŉ", "\x00", "​", "_", "the", "ing", "½", "×"]
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(40)]
        offsets, ids = words.texts(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [
            tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
