"""Each operator against a brute-force version, a round trip or held-out rows; odd rows; empty tables."""

import itertools
import pickle
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from earmark.llm import components, decontaminate, exact, langid, lines, lm, minhash, mixing, packing, queries, simhash, toxicity, wrappers
from earmark.llm.common import pin

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, size string, _c0 int, tag int, root int"
LONG = "word " * 30_000
TEXTS = [None, "", " \n\t", "one", "One", "one two three four five six", "Ünïcode – ÉTÉ", "a\nb\nc\nd\na\nb\nc", LONG, LONG]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "en", "s", 1, "x", "x", "x", 1, 1, 1) for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", None, None, None, None, None, None, None, None)] * 2 + [(None, t, None, None) + (None,) * 7 for t in ("one two", None, "one two")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def sample(docs, n=150):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").limit(n).collect()]


# SimHash


def naive_fingerprint(text):
    parts = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    grams = [b" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or ([b" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_groups(rows, budget=2):
    prints = [naive_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= budget:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(((d, prints[i], least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found_groups(df):
    return sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)


def test_simhash_groups(spark, docs, odd, empty):
    rows = sample(docs, 250)
    assert found_groups(spark.createDataFrame(rows, "doc_id long, text string")) == naive_groups(rows)
    assert found_groups(odd) == naive_groups([(r.doc_id, r.text) for r in odd.collect()])
    assert found_groups(empty) == []


def test_spark_hash_is_the_fingerprints_hash(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("a bc däf"))).first()[0]
    assert value % (1 << 64) == xxhash.xxh64_intdigest("a bc däf".encode(), 42)


@pytest.mark.parametrize("cell", [4096, 16])
def test_near_pairs_find_every_pair_once(spark, cell):
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(60)]
    values = set(base) | {b ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for b in base for _ in range(4)}
    values |= {(0xABCDEF << 40) | draw.getrandbits(9) for _ in range(300)}  # a cell with very many
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pairs = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), cell=cell).collect()
    got = sorted(tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in pairs)
    assert got == sorted(tuple(sorted(p)) for p in itertools.combinations(values, 2) if (p[0] ^ p[1]).bit_count() <= 2)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 2), (2, 1), (2, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]} | {1: 1, 2: 1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive_copies(rows):
    """Smallest id of each row's group, by comparing all pairs."""
    def grams(text):
        parts = (text or "").encode().lower().split()
        return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)} or ({tuple(parts)} if parts else set())

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def test_edited_copies_leave_the_pipeline(spark, docs, odd, empty):
    import corpus_pipeline as c

    draw = random.Random(5)
    rows = sample(docs, 300)
    for k in range(20):
        text = [f"w{draw.randrange(3000)}" for _ in range(400)]
        rows.append((20_000 + 10 * k, " ".join(text)))
        # Each is an edit of the one before: 8 words changed far from each other leave 356 of 436 shingles equal, 10 leave 346 of 446.
        for n, edits in enumerate((8, 8, 10), 1):
            text = list(text)
            for e in range(edits):
                text[10 + 30 * e + 7 * n] = f"x{n}e{e}"
            rows.append((20_000 + 10 * k + n, " ".join(text)))
    rows += [(30_000, None), (30_001, ""), (30_002, "a b"), (30_003, "A  b"), (30_004, "a c")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], docs.schema)
    want = naive_copies(rows)
    assert {r.id: r.component_id for r in minhash.near_copies(df).collect()} == want
    kept = {r.doc_id for r in c.near_copies(spark, df, FOLDER).collect()}
    assert kept == set(want.values()) and 20_000 in kept and not {20_001, 20_002} & kept and 20_003 in kept
    assert minhash.near_copies(odd).count() == odd.count() and minhash.near_copies(empty).count() == 0


def family(draw, n, changed, length=300):
    """Texts that each change other words of one text."""
    base = [f"w{draw.randrange(5000)}" for _ in range(length)]
    out = []
    for k in range(n):
        text = list(base)
        for at in draw.sample(range(length // 6), changed):
            text[at * 6] = f"x{k}y{at}"
        out.append(" ".join(text))
    return out


def test_families_above_and_below_the_similarity(spark, monkeypatch):
    """Members with 0.6 to 0.85 in common with each other; chains over several components; one text many are compared with."""
    monkeypatch.setattr(minhash, "LANE", 4)
    draw = random.Random(11)
    texts = [t for changed in (2, 3, 4, 5, 6, 8) for t in family(draw, 40, changed)] + [LONG, LONG + "end", "a b c d e", "a b c d e f", None, ""]
    rows = list(enumerate(texts, 100))
    got = {r.id: r.component_id for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == naive_copies(rows) and 20 < len(set(got.values())) < 200


def test_near_copies_first_compare_what_tries_of_fingerprints_name(spark, monkeypatch):
    """The first comparisons are those of each fingerprint with the nearest smaller one in reach; the groups are those of brute force all the same."""
    draw = random.Random(16)
    texts = [t for _ in range(4) for t in family(draw, 25, 1)] + ["a b c d e f", "f e d c b a", "", None, " "]
    rows = list(enumerate([*texts, texts[0].upper()], 100))
    prints = {}
    for text in texts:
        found = minhash.shingles((text or "").encode())
        if len(found):
            bits = [sum(int(h) >> k & 1 for h in found) * 2 > len(found) for k in range(64)]
            value = sum(b << k for k, b in enumerate(bits))
            value, node = value - (value >> 63 << 64), xxhash.xxh64_intdigest(found.tobytes(), 42) - (1 << 63)
            prints[value] = min(node, prints.get(value, node))
    want = set()
    for value, node in prints.items():
        near = [(((value ^ o) & (1 << 64) - 1).bit_count(), o & (1 << 64) - 1, o) for o in prints if o < value]
        near = [x for x in near if x[0] <= 4]
        if near:
            other = prints[min(near)[2]]
            want.add((max(node, other), min(node, other)))
    compared, links = [], minhash._links
    monkeypatch.setattr(minhash, "_links", lambda held, pairs: compared.append({tuple(r) for r in pairs.select("a", "b").collect()}) or links(held, pairs))
    got = {r.id: r.component_id for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == naive_copies(rows)
    assert len(want) > 20 and want <= compared[0]


def test_rare_shingles_keep_a_family_apart(spark):
    draw = random.Random(12)
    texts = family(draw, 150, 25)
    nodes = spark.createDataFrame([(i, len(minhash.shingles(t.encode())), i) for i, t in enumerate(texts)], "node long, size long, root long")
    held = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    mixed = minhash._mixed(minhash._prefixes(held, nodes.select("node", "size")), nodes.select("node", "root"))
    assert minhash._rare_pairs(mixed).count() < 150 and minhash._least_pairs(mixed).count() < 150  # of 11,175 pairs


def test_parities_leave_out_only_what_is_less_similar(spark, monkeypatch):
    """Families at 0.55 to 0.8: few pairs that aren't similar enough are compared by their texts, and none that is gets lost."""
    draw = random.Random(13)
    texts = [t for changed in (4, 5, 6, 8, 10) for t in family(draw, 60, changed)]
    sets = [minhash.shingles(t.encode()) for t in texts]
    for a, b in itertools.combinations(range(0, len(sets), 7), 2):
        odd = (np.array(minhash.parities(sets[k]), np.int64).view(np.uint8) for k in (a, b))
        assert np.unpackbits(np.bitwise_xor(*odd)).sum() <= len(np.setxor1d(sets[a], sets[b]))
    compared, links = [], minhash._links
    monkeypatch.setattr(minhash, "_links", lambda held, pairs: compared.append(pairs.count()) or links(held, pairs))
    rows = list(enumerate(texts, 100))
    got = {r.id: r.component_id for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == naive_copies(rows)
    similar = sum(minhash.similar(a, b) for a, b in itertools.combinations(sets, 2))
    assert sum(compared) < 3 * len(texts) + similar, (compared, similar)


def test_blocks_of_a_list_meet_as_all_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    draw = random.Random(15)
    rows = [(draw.randrange(4), k, draw.randrange(6), 100 + draw.randrange(30), 1 + draw.randrange(25), [draw.getrandbits(63) - (1 << 62) if draw.random() < 0.1 else -1] * 8) for k in range(60)]
    rows += [(s + 1, k, r, n, p, o) for s, k, r, n, p, o in rows if k % 3 == 0]
    mixed = spark.createDataFrame(rows, "shingle long, node long, root long, size long, place long, odd array<long>")
    want = {}
    for x, y in itertools.combinations(rows, 2):
        differ = sum((a ^ b).bit_count() if a ^ b >= 0 else ((a ^ b) + (1 << 64)).bit_count() for a, b in zip(x[5], y[5]))
        both = x[3] + y[3]
        if x[0] == y[0] and x[2] != y[2] and 9 * (min(x[3] - x[4], y[3] - y[4]) + 1) >= 4 * both and 5 * min(x[3], y[3]) >= 4 * max(x[3], y[3]) and 9 * differ <= both:
            want[max(x[1], y[1]), min(x[1], y[1])] = differ
    assert want and {tuple(r) for r in minhash._rare_pairs(mixed).collect()} == set(want)
    best = set()
    for node in {k for pair in want for k in pair}:
        best.add(min((d, sum(pair) - node, pair) for pair, d in want.items() if node in pair)[2])
    assert {tuple(r) for r in minhash._best_pairs(mixed).collect()} == best


# Decontamination


def naive_leaks(rows, items):
    out = set()
    grams = {k: decontaminate.shingles(decontaminate.terms((t or "").encode())) for k, t in items}
    for d, t in rows:
        own = decontaminate.shingles(decontaminate.terms((t or "").encode()))
        out |= {(d, k) for k, g in grams.items() if g and len(g & own) >= 0.8 * len(g)}
    return out


def test_leaks(spark, docs, odd, empty):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r.id, r.item_id) for r in got} == naive_leaks(rows, items) and len(got) >= 10
    near = spark.createDataFrame([(1, "x y " * 90 + items[0][1][:-12] + " z" * 200), (2, items[0][1][: len(items[0][1]) // 2])], "doc_id long, text string")
    assert {(r.id, r.item_id) for r in decontaminate.contaminated(near, benchmark).collect()} == {(1, items[0][0])}
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    other = spark.createDataFrame([(1, "one two three four five six", "x"), (2, None, None), (3, "", "x"), (4, "one", "")], "item_id long, text string, answer string")
    assert sorted({(r.id, r.item_id) for r in decontaminate.contaminated(odd, other).collect()}, key=str) == [(3, 4), (4, 4), (5, 1), (5, 4), (None, 4)]
    assert decontaminate.contaminated(odd, other.limit(0)).count() == 0
    answered = decontaminate.contaminated(odd, other.filter("item_id = 1").withColumn("answer", F.lit("one two three")), answer="answer")
    assert answered.count() == 0  # the answer's words stand in the text once only
    assert len(list(decontaminate._item_blocks(other.select(F.col("item_id").alias("_c0"), F.col("text").alias("_c1"), F.col("answer").alias("_c2"))))) == 1


def test_items_in_several_passes_find_the_same(spark, docs, monkeypatch):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = {(r.id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 25)
    assert {(r.id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == whole


def test_wand_equals_scoring_all():
    draw = random.Random(2)
    vocabulary = [f"w{int(draw.paretovariate(0.7)) % 300}" for _ in range(3000)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(5, 30))), None) for i in range(80)]
    index = decontaminate.Index.build(items)
    index.prepare()
    hits = 0
    for _ in range(200):
        own = draw.choice(items)[1].split()
        query = np.unique([index.ids[t.encode()] for t in [*own[draw.randrange(3) :], *draw.choices(vocabulary, k=40)] if t.encode() in index.ids])
        scores = np.zeros(len(index.items))
        for t in query:
            scores[index.postings[t][0]] += index.postings[t][1]
        want = np.flatnonzero(scores >= 1 - 1e-9).tolist()
        assert [i for i, _ in index.search(query)] == want
        assert not want or len(index.open_blocks(query))
        hits += len(want)
    assert hits > 50


# Mixing


def naive_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * share for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix(spark, docs, odd, empty):
    for df, near in ((docs, 0.01), (odd, 1.0)):
        got = mixing.mix(df).collect()
        assert Counter((r.id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, len((r.text or "").split())) for r in df.collect())
        sizes, taken = Counter(), Counter()
        for r in got:
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 and len(r.shards) == r.copies
        want = naive_targets(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert all(abs(taken[s] - want[s]) <= near * max(1, want[s]) for s in want)
        assert sorted(map(str, mixing.mix(df.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0


def test_mixed_rows(docs, odd):
    for df in (docs, odd):
        want = Counter()
        for r in mixing.mix(df).collect():
            want[r.id, r.source] += r.copies
        out = mixing.mixed(df)
        assert out.columns == [*df.columns, "_shard", "_order"]
        got = Counter((r.doc_id, r.source) for r in out.collect())
        assert got == Counter({k: n for k, n in want.items() if n})


def test_mixed_rows_keep_columns_of_any_name(spark, docs):
    names = ["_shard", "_copy", "_size", "_Order", "_language", "_tag", "row", "shard", "block", "drawn", "extra", "taken"]
    df = docs.limit(300).withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    out = mixing.mixed(df)
    assert out.columns == [*df.columns, "__shard", "__order"]
    rows = out.drop("__shard", "__order").collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
    plan = {r.id: r.shards for r in mixing.mix(df).collect()}
    assert Counter((r.doc_id, r["__shard"]) for r in out.collect()) == Counter((d, s) for d, shards in plan.items() for s in shards)
    split = mixing.mixed(df, shards=3)
    assert {r["__shard"] for r in split.collect()} == {0, 1, 2}
    by = split.select(F.spark_partition_id().alias("p"), "__shard", "__order").collect()
    for p in {r.p for r in by}:
        own = [(r["__shard"], r["__order"]) for r in by if r.p == p]
        assert own == sorted(own)


def test_stages_keep_columns_of_any_name(spark, docs):
    import corpus_pipeline as c

    names = ["_shard", "_copy", "_size", "_order", "_language", "_tag", "row", "root", "tag", "id"]
    df = docs.limit(200).unionByName(docs.limit(5)).withColumns({x: F.concat(F.lit(x), "doc_id") for x in names})
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, df, FOLDER)
        assert out.columns == df.columns, name
        assert all(r[x] == f"{x}{r.doc_id}" for r in out.collect() for x in names), name


def test_quotas_are_exact_and_hypergeometric(spark):
    draws = spark.createDataFrame([("a", 300), ("b", 100), (None, 7), ("c", 0)], "source string, n long")
    firsts = []
    for seed in range(25):
        got = mixing._quotas(draws, 5, seed).collect()
        assert Counter({s: sum(r.last - r.first for r in got if r.source == s) for s in ("a", "b", None, "c")}) == Counter({"a": 300, "b": 100, None: 7, "c": 0})
        loads = [sum(r.last - r.first for r in got if r.shard == k) for k in range(5)]
        assert max(loads) - min(loads) <= 2
        firsts.append(sum(r.last - r.first for r in got if r.shard == 0 and r.source == "a"))
    assert abs(np.mean(firsts) - 81 * 300 / 407) < 3 and np.std(firsts) < 8 and len(set(firsts)) > 3


# Packing


def test_packing_round_trip(spark, docs, odd, empty):
    import tiktoken

    ranks = packing.read_ranks(spark, packing.VOCABULARY)
    encoding = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df, length in ((docs.limit(200), 512), (odd, 64)):
        got = packing.pack(df.coalesce(2), length=length, buffer=20_000).collect()
        parts, used = {}, 0
        for r in got:
            assert len(r.ids) == len(r.positions) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
            assert len(r.cu_seqlens) == len(r.doc_ids) + 1 == len(r.offsets) + 1 and set(r.ids[r.n_tokens :]) <= {len(ranks)}
            used += r.n_tokens
            for d, o, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
                assert r.positions[a:b] == list(range(b - a))
                parts.setdefault((d, o), []).append(r.ids[a:b])
        want = Counter((r.doc_id, r.text or "") for r in df.collect())
        pieces = Counter((d, o, tuple(p)) for (d, o), ps in parts.items() for p in ps)
        for (d, text), n in want.items():
            ids = [*encoding.encode_ordinary(text), len(ranks)]
            for o in range(0, len(ids), length):
                pieces[d, o, tuple(ids[o : o + length])] -= n
        assert not any(pieces.values())
        assert used >= 0.9 * length * (len(got) - 4)
    assert packing.pack(empty).count() == 0


def test_long_white_space(spark, monkeypatch):
    import tiktoken

    encoding = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=packing.read_ranks(spark, packing.VOCABULARY), special_tokens={})
    draw = random.Random(9)
    texts = ["".join(draw.choice(("a", "B1", ".", "é", " ", "\n", "\t", "\u3000", " " * 7, "\n \n" * 4, "'s")) for _ in range(60)) for _ in range(300)]
    monkeypatch.setattr(packing, "LONG_SPACE", 5)
    assert all(packing.token_ids(encoding, t) == encoding.encode_ordinary(t) for t in texts)
    monkeypatch.undo()
    for text in ("a" + " " * 2_000_000 + "b", " \n" * 600_000, "x\n" + "\t" * 1_200_000 + "y " * 200_000):
        assert encoding.decode(packing.token_ids(encoding, text)) == text


def test_best_fit_equals_naive():
    draw = random.Random(3)
    for _ in range(30):
        lengths = np.array([draw.randint(1, 100) for _ in range(draw.randint(1, 80))])
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= n
            else:
                rooms.append(100 - n)
        rows = packing.best_fit(lengths, 100)
        assert sorted(p for r in rows for p in r) == list(range(len(lengths)))
        assert sorted(100 - int(lengths[r].sum()) for r in rows) == sorted(rooms)


# Language


def test_language(spark, docs, odd, empty):
    got = [r for r in queries.QUERIES["op7_language"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    model = langid.fit(docs, "text", "lang")
    told = langid.identify(odd, model).collect()
    assert len(told) == odd.count() and set(told[0].asDict()) == {*odd.columns, "_language"}
    assert all((r._language.lang == "und" and r._language.score == 0) == (not any(c.isalpha() for c in r.text or "")) for r in told)
    assert model.predict("漢字 漢字")[1] == pytest.approx(1 / len(model.languages)) and model.predict("12 ² _ !") == ("und", 0.0)
    nothing = langid.fit(empty, "text", "lang")
    assert nothing.predict("one") == ("und", 0.0) and langid.identify(empty, model).count() == 0


def test_copies_teach_once(spark):
    rows = [(i, f"eins zwei drei w{i % 50}", "de") for i in range(200)] + [(i, "one two three", "en") for i in range(3000)] + [(9000 + i, f"four five six v{i}", "en") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", texts_per_language=100)
    at = model.languages.index("en")
    assert model.predict("five")[0] == "en" and model.predict("drei")[0] == "de"
    assert 10 ** float(model.table[model.words["one"], at]) == pytest.approx(1 / (3 + 20 * 4))


# Exact copies


def test_slots_are_minimal_and_perfect():
    for n in (1, 2, 3, 100, 5000):
        digests = np.frombuffer(np.random.default_rng(n).bytes(32 * n), np.uint8).reshape(n, 32)
        displacement, slot = exact.build_slots(digests)
        assert sorted(slot.tolist()) == list(range(n)) and (exact.find_slots(digests, displacement, n) == slot).all()


def test_exact_groups(docs, odd, empty, monkeypatch):
    monkeypatch.setattr(exact, "PART", 64)
    for df in (docs, odd):
        old = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
        got = exact.exact_groups(df.filter(old), df.filter(~old)).collect()
        groups = {}
        for r in df.collect():
            groups.setdefault((r.text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")), []).append(r.doc_id)
        want = Counter((d, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g)
        assert Counter((r.id, r.keep_id, r.group_size) for r in got) == want
        assert sum(r.kept for r in got) == len(groups) and all(r.id == r.keep_id for r in got if r.kept)
    for a, b in ((odd, empty), (empty, odd)):
        assert sum(r.kept for r in exact.exact_groups(a, b).collect()) == len({(r.text or "").lower() for r in odd.collect()})
    assert exact.exact_groups(empty, empty).count() == 0


# Language model


def test_filter_never_loses_a_level():
    keys = np.random.default_rng(4).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    levels = np.random.default_rng(5).integers(1, 6, len(keys))
    made = {}
    for s in np.unique(lm.segment_of(keys)):
        own = lm.segment_of(keys) == s
        made[int(s)] = lm.build_segment(keys[own], levels[own]).tobytes()
    found = lm.LevelFilter.join(made)
    assert (found.levels(keys) >= levels).all() and (found.levels(keys) > levels).mean() < 0.05
    assert (found.levels(np.random.default_rng(6).integers(0, 1 << 63, 20_000, dtype=np.uint64)) > 0).mean() < 0.05


def naive_base(train, rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(d, t): (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows}


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 50])
def test_scores(spark, docs, odd, empty, frequent):
    train = docs.filter("doc_id % 5 <> 0")
    model = lm.train(train, frequent=frequent)
    texts = [r.text for r in train.collect()]
    test = docs.filter("doc_id % 5 = 0").limit(40).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in test.collect()]
    want = naive_base(texts, rows)
    got = lm.score(test, model).collect()
    assert sorted((str(r.id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted((str(d), *want[d, t][:2], round(want[d, t][2], 6)) for d, t in rows)
    held = lm.score(docs.filter("doc_id % 5 = 0"), model).agg(F.avg((F.col("score") > F.col("base_score")).cast("int")), F.max("score")).first()
    assert held[0] > 0.9 and held[1] < 0
    assert lm.score(empty, model).count() == 0
    assert {(r.base_score, r.score) for r in lm.score(odd, lm.train(empty)).collect()} == {(0.0, 0.0)}


def test_scores_in_several_passes_are_the_same(spark, docs):
    train = docs.filter("doc_id % 5 <> 0")
    one, many = lm.train(train), lm.train(train)
    segments = sorted(s for s in one.shards[0])
    many.shards = [segments[::3], segments[1::3], segments[2::3]]
    rows = docs.limit(60).unionByName(docs.limit(5))
    a, b = ([(r.id, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in lm.score(rows, m).orderBy("id", "n_tokens").collect()] for m in (one, many))
    assert a == b and len(a) == 65


@pytest.fixture(scope="module")
def few_words(spark):
    """Many pairs of few words."""
    draw = random.Random(3)
    return spark.createDataFrame([(i, " ".join(f"w{int(400 * draw.random() ** 2)}" for _ in range(draw.randrange(600)))) for i in range(300)], "doc_id long, text string").repartition(3)


def naive_score(model, pairs, text):
    """One token after another."""
    unknown = model.once / model.total if model.once else 1 / (model.total + 1)
    out, before = 0.0, lm.END_HASH
    for word in [*(text or "").encode().lower().split(), b"\n"]:
        token = np.uint64(lm.xxhash.xxh3_64_intdigest(word))
        h, w = model.unigrams.levels(np.array([before, token])).tolist()
        c = lm.MEANS[pairs.levels(lm.pair_keys(np.array([before]), np.array([token])))[0]]
        single = (1 - unknown) * min(lm.MEANS[w] / model.total, 1) if w else unknown
        p = min((c + model.followers[h] * single) / (lm.MEANS[h] + model.followers[h]), 1) if h else single
        out += np.log10(max(p, min(single, 1e-12)))
        before = token
    return out


def test_scores_equal_brute_force_over_many_shards(few_words, odd, monkeypatch):
    """Small shards, blocks and rows; some pairs fall into segments that are empty."""
    for name, value in (("LEAST_SHARD", 1 << 12), ("BLOCK_TOKENS", 3000), ("BLOCK_DOCS", 7), ("ROW_KEYS", 100)):
        monkeypatch.setattr(lm, name, value)
    for train, least in ((few_words.filter("doc_id % 5 <> 0"), 10), (few_words.filter("doc_id in (1, 2)"), 1)):
        model = lm.train(train, frequent=50)
        assert len(model.shards) >= least
        pairs = lm.LevelFilter.join({r.segment: bytes(r.data) for r in model.pairs.filter("segment >= 0").collect()})
        test = few_words.filter("doc_id < 40").unionByName(few_words.filter("doc_id < 4")).unionByName(odd.select("doc_id", "text"))
        want = sorted((str(r.doc_id), round(naive_score(model, pairs, r.text), 6)) for r in test.collect())
        assert sorted((str(r.id), round(r.score, 6)) for r in lm.score(test, model).collect()) == want


def test_the_filter_of_pairs_stays_off_the_driver(spark, few_words, monkeypatch):
    """What the driver gets as one value or broadcasts doesn't hold the pairs' filter."""
    sent, context = [], type(spark.sparkContext)
    broadcast, gathered = context.broadcast, lm._collected
    monkeypatch.setattr(context, "broadcast", lambda self, value: (sent.append(len(pickle.dumps(value))), broadcast(self, value))[1])
    monkeypatch.setattr(lm, "_collected", lambda segments: (found := gathered(segments), sent.append(found.data.nbytes))[0])
    model = lm.train(few_words, frequent=50)
    assert lm.score(few_words, model).count() == 300
    whole = model.pairs.filter("segment >= 0").agg(F.sum(F.octet_length("data"))).first()[0]
    assert sent and max(sent) < whole


# Toxicity


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(7)
    field = toxicity.Crf({}, draw.normal(size=4), draw.normal(size=4), draw.normal(size=4), draw.normal(size=(3, 2)), np.zeros(0), np.zeros(0), 0.0)
    chain = [(0,), (), (1, 2), (3,), ()]
    weight, mask = field.potentials([chain, chain[:2]], 5)
    toxic, change, whole = field.marginals(weight, mask)
    total, by = 0.0, np.zeros(5)
    for tags in itertools.product((0, 1), repeat=5):
        s = field.change[2][tags[0]] + sum(w for w, t in zip(weight[0], tags) if t) + sum(field.change[a][b] for a, b in zip(tags, tags[1:]))
        total += np.exp(s)
        by += np.exp(s) * np.array(tags)
    assert np.allclose(toxic[0], by / total) and np.isclose(whole[0], np.log(total)) and np.allclose(change[0].sum(axis=(1, 2)), 1)
    assert (toxic[1, 2:] == 0).all() and (change[1, 1:] == 0).all()


def test_toxicity(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = queries.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    caught = [r.predicted for r in got if r.toxic == 1]
    assert np.mean(caught) > 0.7 and np.mean([r.predicted for r in got if r.toxic == 0]) < 0.02
    assert any(r.spans for r in got if r.toxic == 1)
    model = toxicity.fit(docs, labels)
    found = toxicity.toxic_spans(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    insult = max(model.ids, key=lambda f: model.own[model.ids[f]] if f.startswith(b"=") else -9)[1:].decode()
    spans = toxicity.toxic_spans(spark.createDataFrame([(1, f"{insult} filler {insult}, {insult}")], "doc_id long, text string"), model).first()
    assert {0, 2, 3} <= {s.word for s in spans.spans}
    assert toxicity.toxic_spans(empty, model).count() == 0
    assert {r.score for r in toxicity.toxic_spans(odd, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_repeated_ids_and_long_texts_teach_within_bounds(spark, monkeypatch):
    draw = random.Random(8)
    rows = [(i, " ".join(["zapf"] * (i % 2) + [f"w{draw.randrange(300)}" for _ in range(40)]), i % 2) for i in range(400)]
    rows += [(1, f"zapf w{k} w{k + 1}", 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    taught = []
    monkeypatch.setattr(toxicity, "pin", lambda frame, label: taught.append((label, made := pin(frame, label))) or made)
    model = toxicity.fit(df, df)
    assert dict(taught)["taught"].count() == 400 and b"=zapf" in model.ids
    small = toxicity.fit(df, df, most_chars=20_000)
    assert b"=zapf" in small.ids and len(small.ids) <= len(model.ids)


def test_lexicon_of_many_rare_toxic_words(spark):
    """Each word is in 4 % of the toxic documents and in no clean one: too few for a normal test, yet certain."""
    draw = random.Random(7)
    rows, insults = [], [f"{a}{b}zq" for a, b in itertools.product("bdfgk", ("ama", "olo", "iri", "unu", "eve"))]
    for i in range(1200):
        text = [f"{chr(97 + draw.randrange(26))}w{draw.randrange(400)}" for _ in range(60)]
        if i % 2:
            text[draw.randrange(60)] = insults[i // 2 % 25]
        rows.append((i, " ".join(text), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df)
    assert {b"=" + w.encode() for w in insults} <= model.ids.keys()
    found = {r.id: r for r in toxicity.toxic_spans(df, model).collect()}
    assert np.mean([found[i].score >= 0.5 for i in range(1, 1200, 2)]) > 0.95 and np.mean([found[i].score >= 0.5 for i in range(0, 1200, 2)]) < 0.05
    assert np.mean([len(found[i].spans) > 0 for i in range(1, 1200, 2)]) > 0.95


# Pages

CHROME = [
    '<nav><ul><li><a href="/a">M{0}</a></li><li><a href="/b">N</a></li></ul></nav>', "<header>H{0}</header>", "<script>var a='</p>{0}';</script>", "<style>p{{x:{0}}}</style>",
    '<div class="ad">Buy {0}</div>', "<aside>Side {0}</aside>", '<div id="cookie-notice">We use {0}</div>', "<form><label>Mail</label><input></form>",
]
TAIL = ['<section class="comments"><p>Nice {0}</p></section>', "<footer>&copy; F{0}</footer>"]


def page(i, main='<article><h1>T{0} &amp; x</h1><p><b>One\n  two&nbsp;{0}<p>Three <i>f</i>our{1}<ul><li>five<li>six {0}</ul></article>'):
    return "<html><head><title>T</title></head><body>" + "".join(c.format(i) for c in CHROME[: 4 + i % 5]) + main.format(i, "" if i % 2 else "</p><p>seven") + "".join(c.format(i) for c in TAIL) + ("</body></html>" if i % 3 else "")


def test_main_text(spark, empty):
    rows = [(i, f"http://h{i % 3}.example/{i}", page(i)) for i in range(30)]
    rows += [(30, None, None), (31, "x", ""), (32, "http://h0.example", "plain &lt;text&gt;  only"), (None, None, "<p>a<p>b"), (33, "http://q.example", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("wrapper", F.lit(None).cast("string"))
    got = {r.id: r.text for r in wrappers.extract(df).collect()}
    for i in range(30):
        seven = [] if i % 2 else ["seven"]
        assert got[i].split("\n") == [f"T{i} & x", f"One two {i}", "Three four", *seven, "five", f"six {i}"]
    assert (got[30], got[31], got[32], got[None], got[33]) == ("", "", "plain <text> only", "a\nb", "deep")
    assert wrappers.extract(df.limit(0)).count() == 0


def test_pages_without_an_article(spark):
    body = '<div class="top">Site name</div><div class="body-text"><p>Story {0} goes on and on.</p></div><div><ul><li><a href="/">Link one {0}</a></li></ul></div>'
    rows = [(i, "http://h.example/", page(i, body)) for i in range(12)]
    got = {r.id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} goes on and on." for i in range(12)}


@pytest.mark.parametrize("body", [
    '<body><article class="post has-comments"><p>Text</article>', '<body><main class="no-sidebar"><p>Text</main>', '<body class="has-sidebar"><p>Text',
    '<body><div id="page" class="site has-sidebar"><article><p>Text</article></div>', '<body><div id="page" class="site has-sidebar"><p>Text</div>',
    '<body><div class="sidebar"><article class="menu"><p>Text</article></div>', "<article><p>Text</article>", "<p>Text", "Text"])
def test_names_and_heads_lose_no_article(body):
    for head in ("", "<head>", "<head><meta charset=utf-8><title>T</title><script>a='<p>'</script>", "<head><title>T</title></head>"):
        page = f"<html>{head}{body}"
        assert wrappers.main_text(page, wrappers.Rules.of(*wrappers.infer([page]))) == "Text"
    page = '<body><p>Text<div class="site-footer">F</div><div class="related">R</div><div id="mainMenu">M</div>'
    assert wrappers.main_text(page, wrappers.Rules.of(*wrappers.infer([page]))) == "Text"


def test_wrapper_has_groups_and_slots():
    made, n = wrappers.infer(["<article><h1>A</h1><p>x<p>y</article>", "<article><h1>A</h1><p>z</p><ul><li>k</ul></article>", "<article><h1>A</h1><p>x<p>y</article>"])
    article = made.inside[0]
    assert n == 2 and [(p.key, p.times) for p in article.inside] == [("h1", "1"), ("p", "+"), ("ul", "?")]
    assert article.inside[0].inside[0].kind == "text" and article.inside[1].inside[0].kind == "slot"


def _extracted(pages):
    rules = wrappers.Rules.load(wrappers.Rules.of(*wrappers.infer(pages)).dump())
    return [wrappers.main_text(p, rules) for p in pages], [wrappers.main_text(p, wrappers.Rules(False, {}, set())) for p in pages]


def _story(i, n=12):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_the_wrapper_decides_inside_the_article(spark):
    """A notice under a name in no list, and teasers and comments that are article elements, leave the result; without the wrapper they would stay."""
    def article(i):
        note = '<div class="zq7"><h3>Dear reader</h3><p>Pay us</p></div><p class="k9">As seen elsewhere</p>'
        quote = f'<div class="qq">Q{i}</div>' if i == 2 else ""
        own = f"<article><h1>T{i}</h1><p>{_story(i)}</p>{note}<h2>Background</h2>{quote}<p>Same words</p><ul><li>One</li></ul><div>{_story(i + 50)}</div>"
        replies = "".join(f'<article class="comment"><p>Nice {i} {k}</article>' for k in range(1 + i % 2))
        cards = "".join(f'<article class="card"><h3>Card {i} {k}</h3><p>{_story(i + 90 + k, 5)}</p></article>' for k in range(2 + i % 2))
        return f"<body>{own}{replies}</article><section>{cards}</section></body>"

    def want(i):
        return "\n".join([f"T{i}", _story(i), "Background", *([f"Q{i}"] if i == 2 else []), "Same words", "One", _story(i + 50)])

    pages = [article(i) for i in range(6)]
    got, without = _extracted(pages)
    assert got == [want(i) for i in range(6)]
    assert all("Pay us" in t and "As seen elsewhere" in t and "Nice" in t and "Card" in t for t in without)
    df = spark.createDataFrame([(i, "http://h.example/", article(i)) for i in range(40)], "page_id long, url string, html string")
    assert {r.id: r.text for r in wrappers.extract(df).collect()} == {i: want(i).replace("\nQ2", "") if i != 2 else want(2) for i in range(40)}


def test_all_pages_of_a_host_teach_its_wrapper(spark, monkeypatch):
    """What one page of 200 has otherwise counts, wherever it stands: its text in a block, and cards that repeat on it alone. Pages without an article teach their own kind."""
    def article(i, odd):
        cards = "".join(f'<article class="card"><h3>Card {i} {k}</h3></article>' for k in range(2 if i == odd else 1))
        return f'<body><article><h1>T{i}</h1><p>{_story(i)}</p><div class="z1">{"Sold" if i == odd else "In stock"}</div><div class="z2">Pay us</div></article><section>{cards}</section></body>'

    def bare(i):
        return f"<body><div>Site name</div><p>{_story(i)}</p></body>"

    def extracted(rows):
        return {r.id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    rows = [(1000 * odd + i, f"http://h{odd}.example/{i}", article(i, odd)) for odd in (3, 11, 19) for i in range(200)]
    rows += [(9000 + i, f"http://h{3 if i else 11}.example/", bare(i)) for i in range(5)] + rows[:7]
    want = {1000 * odd + i: f"T{i}\n{_story(i)}\n" + ("Sold" if i == odd else "In stock") for odd in (3, 11, 19) for i in range(200)}
    want |= {9000 + i: _story(i) if i else f"Site name\n{_story(i)}" for i in range(5)}
    assert extracted(rows) == want
    rules = wrappers.Rules.of(*wrappers.infer([article(i, 19) for i in range(200)]))
    for together, step in ((8, 1), (20, 2)):
        monkeypatch.setattr(wrappers, "TOGETHER", together)
        monkeypatch.setattr(wrappers, "STEP", step)
        shuffled = random.Random(step).sample(rows, len(rows))
        assert extracted(shuffled) == want
        made = {r.host: r.wrapper for r in wrappers.infer_wrappers(spark.createDataFrame(shuffled, "page_id long, url string, html string")).collect()}
        assert wrappers.Rules.load(made["h19.example"]) == rules


def test_lessons_are_the_same_in_any_order():
    """Random pages, united in whole and by parts of the trie, give the rules of all pages aligned one after another; what is kept meanwhile stays small."""
    draw = random.Random(5)
    blocks = ['<div class="a">Same</div>', '<div class="b">{0}</div>', "<ul><li>x<li>{0}</ul>", '<article class="c"><p>{0}</article>' * 2, '<section><div class="d">Twice</div></section>', '<div id="own{0}">{0}</div>']
    pages = sorted({f'<body><article><h1>{i}</h1><p>{_story(i)}</p>' + "".join(b.format(i) for b in blocks if draw.random() < 0.9) + '<div class="e">Always</div></article></body>' for i in range(300)})

    def lesson(page):
        root = wrappers.parse(page)
        return wrappers.Lesson(wrappers._part(root), 1, [wrappers._words(root)]).dump()

    rows = sorted((draw.randrange(-(1 << 63), 1 << 63), lesson(p)) for p in pages)
    whole = wrappers._united(iter(rows + rows[-1:]))
    parts = [wrappers._united(iter(own)) for own in ([r for r in rows if r[0] >> 61 == top] for top in range(-4, 4))]
    again = wrappers._united((top << 61, part.dump()) for top, part in zip(range(-4, 4), parts))
    assert whole.dump() == again.dump() and whole.pages == 300
    assert whole.rules() == wrappers.Rules.of(*wrappers.infer(pages))
    assert any(t == "Always" for _, t in whole.rules().constant) and len(whole.dump()) < 3 * max(len(d) for _, d in rows)


def test_the_wrapper_takes_nothing_without_evidence():
    """Edited copies of one article, two pages, a text of one page alone, and articles of which no single one stands on every page."""
    copy = "<article><h1>T</h1><div class='a'>" + _story(1, 40) + "</div><div class='b'>" + _story(2, 40) + " {0}</div></article>"
    for pages in ([copy.format(i) for i in range(6)], [copy.format(1), copy.replace("w1", "v").replace("w2", "u")]):
        got, without = _extracted(pages)
        assert got == without and all(got)
    lists = ["<body>" + "".join(f"<article class='card'><p>{_story(10 * i + k)}</article>" for k in range(2 + i)) + "</body>" for i in range(5)]
    got, without = _extracted(lists)
    assert got == without and all(len(t.split("\n")) == 2 + i for i, t in enumerate(got))
    # Without an article: what one page alone has isn't what every page has.
    plain = [f"<body><div>Site</div><p>{_story(i)}</p>" + ("<section>Only here</section>" if i == 1 else "") for i in range(5)]
    got, _ = _extracted(plain)
    assert got == [_story(i) + ("\nOnly here" if i == 1 else "") for i in range(5)]


@pytest.mark.parametrize("deep", [50, 117, 118, 119, 300])
def test_deep_nesting_loses_no_text(deep):
    page = "<article><p>Before</p>" + "<div>" * deep + "deep<p>in" + "</div>" * deep + "<p>After</p></article><footer>F</footer><p>out"
    assert wrappers.main_text(page, wrappers.Rules.of(*wrappers.infer([page]))) == "Before\ndeep\nin\nAfter"
    page = "<article>" + "<div><section>" * deep + "x" + "</section>y</div>" * deep + "z</article>"
    assert wrappers.main_text(page, wrappers.Rules(False, {}, set())).split("\n") == ["x", *["y"] * deep, "z"]


def test_very_long_pages_are_aligned(monkeypatch):
    def page(k):
        return "<article>" + "".join(f"<h2>T{i}</h2><p>a{i}<div>b</div>" if (i + k) % 5 else f"<p>c{k}{i}" for i in range(4000)) + "</article>"

    made, n = wrappers.infer([page(1), page(2)])
    assert n == 2 and len(made.inside[0].inside) < 20_000
    monkeypatch.setattr(wrappers, "MOST_CELLS", 0)
    small = [f"<article><h1>A</h1><p>x{k}</p>{'<ul><li>k</ul>' * (k % 2)}</article>" for k in range(4)]
    made, _ = wrappers.infer(small)
    assert [(p.key, p.times) for p in made.inside[0].inside] == [("h1", "1"), ("p", "1"), ("ul", "?")]


# Lines


def naive_lines(rows, run=3, long=50):
    kept = {}
    order = sorted({(d is None, d or 0, t or "", d, t) for d, t in rows}, key=lambda r: r[:2])
    runs = {}
    for none, key, _, d, t in order:
        own = [x.strip(" \t\r") for x in (t or "").split("\n")]
        own = [x for x in own if x]
        found = [(p, run, tuple(own[p : p + run])) for p in range(len(own) - run + 1)]
        for n in range(1, run):
            found += [(p, n, tuple(own[p : p + n])) for p in range(len(own) - n + 1) if sum(len(x.split()) for x in own[p : p + n]) >= long]
        gone = set()
        for p, n, body in found:
            if runs.setdefault((n, body), (d, t, p)) != (d, t, p):
                gone |= set(range(p, p + n))
        kept[d, t] = (len(own), len(gone))
    return kept


def test_lines(spark, docs, odd, empty):
    assert {r.id: r.n_removed for r in lines.remove_repeats(odd).collect() if r.id is not None}[7] == 3
    text = {r.id: r.text for r in lines.remove_repeats(odd).collect()}
    assert text[7] == "a\nb\nc\nd" and text[0] is None and text[1] == "" and text[8] == LONG and text[9] == ""
    rows = sample(docs, 300) + [(9001, "a\n\nb\r\nc\nq"), (9002, "z\na\nb\n \nc\nq\ny"), (9003, "b\nc\nq")]
    got = lines.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = naive_lines(rows)
    assert {r.id: (r.n_lines, r.n_removed) for r in got} == {d: v for (d, _), v in want.items()} and sum(r.n_removed for r in got) > 20
    assert {r.id: r.text for r in got}[9002] == "z\n \ny" and {r.id: r.text for r in got}[9003] == ""
    assert lines.remove_repeats(empty).count() == 0


def test_two_lines_of_many_words_repeat(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, f"{a}\n{b}\nx"), (2, f"y\n {a}\n\n{b} "), (3, f"{a}\nz\n{b}"), (4, f"{a}\n{b}\n{a}\n{b}"), (5, "a0 a1\nb0 b1\nq"), (6, "a0 a1\nb0 b1")]
    got = {r.id: r.text for r in lines.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "y\n", 3: rows[2][1], 4: "", 5: rows[4][1], 6: rows[5][1]}
    want = naive_lines(rows)
    assert {d: n for (d, _), (_, n) in want.items()} == {1: 0, 2: 2, 3: 0, 4: 4, 5: 0, 6: 0}


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = db.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, FOLDER).select(*columns).collect())


@pytest.mark.parametrize("name", ["op6_source_mix", "op9_repeated_lines"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_pipeline(spark, docs, odd, tmp_path):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language", "near_copies", "benchmark_leaks", "mix", "token_ids"]
    assert c.run(spark, FOLDER).count() > 100
    full = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd.collect()], docs.schema)
    for source in (docs, docs.unionByName(full), docs.limit(0)):
        now = source
        ids = [set(r.doc_id for r in now.collect())]
        for k, (name, stage) in enumerate(c.STAGES):
            out = stage(spark, now, FOLDER)
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(path := str(tmp_path / f"{len(list(tmp_path.iterdir()))}"))
            now = spark.read.parquet(path)
            if k < 4:
                ids.append(set(r.doc_id for r in now.collect()))
        own = source.filter(F.col("doc_id").isin([i for i in ids[1] if i is not None]))
        assert {r.component_id for r in minhash.near_copies(own).collect()} == ids[2] - {None}
        if source is docs:
            assert set(naive_copies([(r.doc_id, r.text) for r in own.orderBy("doc_id").collect()]).values()) == ids[2]
        assert not {r.id for r in decontaminate.contaminated(source, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()} & ids[3]
