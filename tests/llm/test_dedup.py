"""Exact, suffix, line and near deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.exact_dedup import exact_dedup, probe
from skein.llm.line_dedup import line_dedup
from skein.llm.near_dedup import drop_near_duplicates, near_dedup
from skein.llm import suffix_dedup
from skein.llm.suffix_dedup import anchors, longest_previous, merged, remove_repeats

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NONE = -(2**63)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_exact(odd, odd_rows):
    groups = defaultdict(list)
    for r in odd_rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert rows_of(exact_dedup(odd)) == want
    assert rows_of(exact_dedup(odd, max_broadcast_mb=0.0002)) == want  # in ranges of 4 words


def test_exact_moves_repeated_rows_alone(spark):
    """Whatever the filter's size, a look-up has no exchange but a broadcast, and most rows miss."""
    rows = spark.range(5000).selectExpr("id AS word", "1L AS mask", "id AS doc_id")
    words = spark.range(100).selectExpr("id AS word", "1L AS set")
    plan = probe(rows, words)._jdf.queryExecution().executedPlan().toString()
    assert plan.replace("BroadcastExchange", "").count("Exchange") == 0
    assert probe(rows, words).filter("maybe").count() == 100
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', cast(least(id, 2900) AS string)) AS text")
    for mb in (256, 0.005):
        sizes = Counter(r["group_size"] for r in exact_dedup(docs, max_broadcast_mb=mb).collect())
        assert sizes == {1: 2900, 100: 100}


def removed(texts: dict, size: int) -> dict:
    first = {}
    for doc in sorted(texts):
        for t in texts[doc]:
            for i in range(len(t) - size + 1):
                first.setdefault(t[i : i + size], doc)
    out = {}
    for doc, all_ in texts.items():
        for t in all_:
            gone = np.zeros(len(t), bool)
            for i in range(len(t) - size + 1):
                if first[t[i : i + size]] < doc:
                    gone[i : i + size] = True
            out[(doc, t)] = gone
    return out


def test_suffix(odd, odd_rows):
    texts = defaultdict(list)
    for r in odd_rows:
        texts[NONE if r[0] is None else r[0]].append((r[1] or "").encode())
    want = Counter()
    for (doc, t), gone in removed(texts, 50).items():
        left = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        for _ in range(texts[doc].count(t)):
            want[(None if doc == NONE else doc, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left)] += 1
    got = remove_repeats(odd)
    assert rows_of(got.drop("spans")) == want
    for r in got.collect():
        assert sum(s["length"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]


def moved(batches):
    """(bucket, doc_id, value) rows by bucket."""
    out = defaultdict(list)
    for batch in batches:
        for r in batch.to_pylist():
            out[r["bucket"]].append(r)
    return {k: pa.Table.from_pylist(v, pa.schema(suffix_dedup._MOVED)) for k, v in out.items()}


def test_suffix_in_loads_and_buckets(monkeypatch):
    """The steps by hand, over several loads of several slices and many buckets."""
    monkeypatch.setattr(suffix_dedup, "_SLICE", 3000)
    monkeypatch.setattr(suffix_dedup, "_LOAD", 10_000)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT_LOAD", 5000)
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60)]
    passages = [" ".join(rng.choice(words, 25)) for _ in range(6)]
    say = lambda n: " ".join(rng.choice(words[:9], n))
    texts = {int(k) * 7 - 900: " ".join([say(rng.integers(0, 30)), passages[k % 6], say(rng.integers(0, 30))]).encode() for k in rng.permutation(300)}
    texts |= {5: texts[-893], 6: b"", 8: passages[0].encode() * 3}
    docs = pa.table({"doc_id": pa.array(list(texts), pa.int64()), "text": [t.decode() for t in texts.values()]})
    shared = defaultdict(list)
    for bucket, rows in moved(suffix_dedup._offers(iter(docs.to_batches()), 50, 37)).items():
        for r in suffix_dedup._answer((bucket,), rows).to_pylist():
            shared[r["doc_id"]].append(r["hash"])
    docs = docs.append_column("shared", pa.array([shared[d] for d in texts], pa.list_(pa.int64())))
    spans = defaultdict(list)
    for bucket, rows in moved(suffix_dedup._segment_loads(iter(docs.to_batches()), 50, 37)).items():
        for r in suffix_dedup._cover(50)((bucket,), rows).to_pylist():
            spans[r["doc_id"]].append((r["start"], r["length"]))
    for (doc, t), gone in removed({d: [t] for d, t in texts.items()}, 50).items():
        got = np.zeros(len(t), bool)
        for a, b in merged(np.array(spans[doc], np.int64).reshape(-1, 2)).tolist():
            got[a:b] = True
        assert (got == gone).all()


def test_suffix_moves_rows_by_loads_not_slices():
    """A task of 16 slices and 5,000 buckets: one row for each bucket, not one for each slice, too;
    and rows that hold what they are about, not the slice's documents."""
    rng = np.random.default_rng(4)
    texts = rng.integers(97, 123, (4000, 7000), np.uint8)
    docs = pa.table({"doc_id": rng.integers(0, 2**60, 4000), "text": [t.tobytes().decode() for t in texts]})
    rows = [r for b in suffix_dedup._offers(iter(docs.to_batches()), 50, 5000) for r in b.to_pylist()]
    assert len(rows) <= 5000
    n_anchors = texts.size / 16
    assert sum(len(r["value"]) for r in rows) < 16 * n_anchors


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=40), min_size=1, max_size=6), st.sampled_from([1, 3, 8, 12]))
def test_longest_previous(texts, depth):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = np.array([len(t) for t in texts])
    base = np.cumsum(sizes) - sizes
    owners, starts, ends, want = [], [], [], []
    for k, t in enumerate(texts):
        for i in range(len(t)):
            owners.append(k // 2)
            starts.append(base[k] + i)
            ends.append(base[k] + len(t))
            earlier = [u for j, u in enumerate(texts) if j // 2 < k // 2]
            n = max((m for m in range(1, len(t) - i + 1) if any(t[i : i + m] in u for u in earlier)), default=0)
            want.append(n if n >= depth else 0)
    got = longest_previous(data, np.array(owners, np.int64), np.array(starts, np.int64), np.array(ends, np.int64), depth)
    assert got.tolist() == want


def test_anchors_do_not_depend_on_blocks_and_merge_runs():
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 700, 720, 5000])
    one, many = anchors(data, offsets, 50), anchors(data, offsets, 50, block=64)
    assert all((a == b).all() for a, b in zip(one, many))
    assert one[1].sum() == (700 - 49) + (4280 - 49)
    assert merged(np.array([[5, 3], [0, 2], [2, 1], [9, 1]])).tolist() == [[0, 3], [5, 8], [9, 10]]


def test_lines(spark, odd, odd_rows):
    seen, later = {}, defaultdict(set)
    for r in sorted((r for r in set(odd_rows) if r[0] is not None), key=lambda r: r[0]):
        ls = (r[1] or "").split("\n")
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if w in seen:
                later[r[0]] |= {i, i + 1, i + 2}
            seen.setdefault(w, r[0])
    want = Counter()
    for r in odd_rows:
        ls, gone = (r[1] or "").split("\n"), later.get(r[0], set())
        text = r[1] if not gone else "\n".join(x for i, x in enumerate(ls) if i not in gone)
        want[(r[0], text, r[5], 0 if r[1] is None else len(ls), len(gone))] += 1
    assert rows_of(line_dedup(odd).select("doc_id", "text", "bin", "n_lines", "n_removed")) == want
    twice = spark.createDataFrame([(1, "a\nb\nc\nx\na\nb\nc"), (2, "a\nb\nc"), (3, "a\nb")], "doc_id long, text string")
    assert {r[0]: r[1] for r in line_dedup(twice).collect()} == {1: "a\nb\nc\nx", 2: "", 3: "a\nb"}


def colliding_windows():
    """Two windows of three lines of 8 bytes whose Spark xxhash64 is the same: on 8 bytes it can be inverted."""
    import random

    top, p1, p2, p3, p4, p5 = 1 << 64, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    turn = lambda x, r: (x << r | x >> 64 - r) % top
    inv = lambda p: pow(p, -1, top)

    def hashed(line, seed):
        h = (seed + p5 + 8) % top ^ turn(int.from_bytes(line.encode(), "little") * p2 % top, 31) * p1 % top
        h = (turn(h, 27) * p1 + p4) % top
        h = (h ^ h >> 33) * p2 % top
        h = (h ^ h >> 29) * p3 % top
        return h ^ h >> 32

    def line_of(h, seed):
        h = (h ^ h >> 32) * inv(p3) % top
        h = (h ^ h >> 29 ^ h >> 58) * inv(p2) % top
        h = turn((h ^ h >> 33) - p4 & top - 1, 0) * inv(p1) % top
        h = turn(h, 37) ^ (seed + p5 + 8) % top
        return (turn(h * inv(p1) % top, 33) * inv(p2) % top).to_bytes(8, "little")

    rng = random.Random(1)
    line = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    one = [line(), line(), line()]
    want = 42
    for x in one:
        want = hashed(x, want)
    while True:
        other = [line(), line()]
        last = line_of(want, hashed(other[1], hashed(other[0], 42)))
        if all(32 <= c < 127 for c in last):
            return "\n".join(one), "\n".join([*other, last.decode()])


def test_lines_of_equal_first_hash(spark):
    from pyspark.sql import functions as F

    texts = colliding_windows()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = F.split("text", "\n")
    assert docs.select(F.xxhash64(*(lines[i] for i in range(3)))).distinct().count() == 1
    assert {r[0]: r[1] for r in line_dedup(docs).select("doc_id", "text").collect()} == dict(enumerate(texts))


def near_groups(rows, percent):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for r in rows:
        ws = word.findall((r[1] or "").translate(LOWER))
        sets[r[0]] = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    up = {i: i for i in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j]) if i < j else 0
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return sets, {i: root(i) for i in ids}


def test_near(odd, odd_rows):
    sets, group = near_groups(odd_rows, 85)
    want = Counter((r[0], len(sets[r[0]]) if r[0] is not None else 0, group.get(r[0]), r[0] is None or group[r[0]] == r[0]) for r in odd_rows)
    assert rows_of(near_dedup(odd)) == want
    _, group = near_groups(odd_rows, 80)
    kept = drop_near_duplicates(odd, percent=80)
    assert kept.columns == odd.columns
    assert rows_of(kept.select("doc_id", "text")) == Counter((r[0], r[1]) for r in odd_rows if r[0] is None or group[r[0]] == r[0])


def test_near_large_group(spark):
    """More near copies than a rare hash may have: the lists of common hashes do the work."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
            words[rng.randrange(150)] = f"x{rng.randrange(3)}"
        rows.append((k, " ".join(words[: 150 - rng.choice([0, 0, 0, 25, 30])])))
    _, group = near_groups(rows, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == group and 3 < len(set(group.values())) < 160


def near_copies(name, words):
    """Word lists of 32 near copies, five words of which come in two versions, and the words all have."""
    base = [f"{name}{i}" for i in range(words)]
    return [[f"{w}v" if i in range(0, 30, 6) and k >> i // 6 & 1 else w for i, w in enumerate(base)] for k in range(32)], base


def assert_near(spark, rows, percent):
    _, group = near_groups(rows, percent)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == group


def test_near_partner_outside_another_list(spark):
    """Only b links a to its group, and b also holds a passage of another group."""
    texts = []
    for f in range(8):
        group, base = near_copies(f"g{f}_", 400)
        others, _ = near_copies(f"h{f}_", 60)
        passage = [f"p{f}_{i}" for i in range(16)]
        b, a = base[24:] + passage, [f"a{f}_{i}" for i in range(36)] + base[30:]
        texts += [b, *group, *(x + passage for x in others), others[0][:50] + passage, a]
    assert_near(spark, [(i, " ".join(x)) for i, x in enumerate(texts)], 85)


def test_near_partner_in_common_lists(spark):
    """a holds a passage of another group, whose lists are shorter than those a shares with b."""
    texts = []
    for f in range(6):
        group, base = near_copies(f"g{f}_", 364)
        others, _ = near_copies(f"h{f}_", 60)
        passage = [f"p{f}_{i}" for i in range(80)]
        a, b = base[30:] + passage, base[30:] + [f"b{f}_0", f"b{f}_1"]
        texts += [a, b, *group, *(x + passage for x in others[:30])]
    assert_near(spark, [(i, " ".join(x)) for i, x in enumerate(texts)], 80)


def test_near_repeated_ids(spark):
    """Rows of one id with different texts are one document, which holds the links of both."""
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(5, a), (5, b), (8, a + " x"), (9, b + " y"), (10, "alone"), (5, "")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5, True), (8, 5, False), (9, 5, False), (10, 10, True)}


def test_near_recall_at_the_threshold(spark):
    """2,000 pairs with similarities from 0.85 to 0.87 and 2,000 from 0.83 on, in texts of 120 to 600 words."""
    import random

    rng = random.Random(11)
    rows, linked = [], 0
    for p in range(4000):
        n = rng.randint(120, 600)
        words = [f"p{p}w{i}" for i in range(n)]
        # a prefix of m shingles of n: similarity m / n
        total, above = n - 4, p % 2 == 0
        least = -(-85 * total // 100)
        m = rng.randint(least, int(0.87 * total)) if above else rng.randint(int(0.83 * total), least - 1)
        at = rng.randint(0, total - m)
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(words[at : at + m + 4]))]
        linked += above
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("NOT kept").select("doc_id", "component_id").collect()
    assert {(r[0], r[1]) for r in got} == {(4 * p + 1, 4 * p) for p in range(2000)} and linked == 2000


def test_names_that_clash(spark):
    rows = [(i, "a b c d e f g\nh\ni j", "mine", "mine", "mine") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line_doc string, LINE_GONE string, near_gone string")
    out = line_dedup(docs).orderBy("doc_id")
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and [r[1] for r in out.collect()] == [rows[0][1], "", ""]
    assert [tuple(r) for r in drop_near_duplicates(docs).collect()] == [rows[0]]


def test_empty(empty):
    for f in (exact_dedup, near_dedup, line_dedup, remove_repeats, drop_near_duplicates):
        assert f(empty).count() == 0
