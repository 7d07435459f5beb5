from itertools import combinations

import numpy as np
import pytest

from repograph.llm import line_dedup as ld
from repograph.llm import marks

SF = "/root/testdata/sf0.001"


def edit(a, b):
    """The edit distance, a column of the matrix as the bits of a number."""
    a, b = sorted((a, b), key=len)
    if not a:
        return len(b)
    places = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0
    for c in b:
        same = places.get(c, 0)
        vertical = same | down
        same = (((same & up) + up) ^ up) | same
        more, less = down | (~(same | up) & every), up & same
        distance += bool(more & top) - bool(less & top)
        more, less = ((more << 1) | 1) & every, (less << 1) & every
        up, down = less | (~(vertical | more) & every), more & vertical
    return distance


def may_be_similar(a, b, similarity):
    """False only where lengths or letters alone exclude it."""
    most = (1 - similarity) * max(len(a), len(b)) + 1e-9
    return abs(len(a) - len(b)) <= most and sum(abs(a.count(c) - b.count(c)) for c in set(a + b)) <= 2 * most


def lines_of(rows):
    """((id, text, line), normalised line) of every line with a word."""
    found = []
    for i, text in rows:
        for k, line in enumerate(ld.normalised(None if text is None else text.encode())):
            if line:
                found.append(((i, text, k), line.decode()))
    return found


def similar(names, similarity=0.8):
    """All pairs of lines with that edit similarity, without any fingerprint."""
    by_length = sorted(names, key=len)
    out = []
    for i, a in enumerate(by_length):
        for b in by_length[i + 1 :]:
            if len(a) < similarity * len(b) - 1e-9:
                break
            if may_be_similar(a, b, similarity) and 1 - edit(a, b) / len(b) >= similarity - 1e-12:
                out.append((a, b))
    return out


def groups(names, pairs):
    group = {n: n for n in names}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in pairs:
        group[root(b)] = root(a)
    return {n: root(n) for n in names}


def candidates(names):
    """Pairs that share a key and whose SimHashes are near, all against all."""
    prints, ends, keys = ld.fingerprints([n.encode() for n in names])
    own = [set(keys[s:e].tolist()) for s, e in zip(np.append(0, ends[:-1]).astype(int), ends.astype(int))]
    return [(a, b) for (i, a), (j, b) in combinations(enumerate(names), 2) if own[i] & own[j] and bin(int(prints[i]) ^ int(prints[j])).count("1") <= ld.DISTANCE]


def gone_lines(found, group):
    """The dropped line numbers of each row, given the groups; places in the order of (id, line), null ids first."""
    order = lambda p: (p[0] is not None, p[0] or 0, p[2])
    stays = {}
    for place, name in sorted(found, key=lambda x: order(x[0])):
        stays.setdefault(group[name], place)
    gone = {}
    for place, name in found:
        if stays[group[name]] != place:
            gone.setdefault(place[:2], set()).add(place[2])
    return gone


def brute(rows, similarity=0.8):
    """The dropped lines, if of all candidate pairs the similar ones are linked; for unique ids."""
    found = lines_of(rows)
    names = sorted({x for _, x in found})
    links = [(a, b) for a, b in candidates(names) if 1 - edit(a, b) / max(len(a), len(b)) >= similarity - 1e-12]
    return gone_lines(found, groups(names, links))


def texts(rng, n):
    vocabulary = [f"w{i}x" for i in range(400)]
    lines = [" ".join(rng.choice(vocabulary, int(k))) for k in rng.integers(1, 60, 40)]
    near = []
    for line in lines:
        words = line.split()
        words[int(rng.integers(len(words)))] = "other"
        near.append(" ".join(words))
    every = lines + near + [x.upper() + " !" for x in lines[:10]] + ["", " --- ", "short", "the same line 12", "The same line 34."]
    return ["\n".join(rng.choice(every, int(k))) for k in rng.integers(0, 9, n)]


def kept_texts(rows, gone):
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, t in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [*enumerate(texts(rng, 60)), (70, None)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, line string, s1 int")
    got = {r.doc_id: r for r in ld.dedup_lines(df).collect()}
    gone = brute(rows)
    assert sum(map(len, gone.values())) > 20 and df.columns == list(got[0].asDict())[:4]
    assert {i: r.text for i, r in got.items()} == kept_texts(rows, gone)
    assert all(got[i].n_lines == len(t.split("\n")) and got[i].n_kept == got[i].n_lines - len(gone.get((i, t), ())) for i, t in rows if t is not None)
    assert got[70].n_lines == got[70].n_kept == 0


@pytest.mark.parametrize("similarity", [0.8, 0.97, 0.985])
def test_families_of_near_lines(spark, similarity):
    """Many near variants, of which some pairs fail: groups are as if all candidate pairs had been compared."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(4):
        base = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(90)]
        for _ in range(30):
            words = list(base)
            for at in rng.integers(0, 90, int(rng.integers(0, 4))):
                words[at] = "else" * int(rng.integers(1, 5))
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.n_kept for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity).collect()}
    gone = brute(rows, similarity)
    assert {i for i, n in got.items() if n == 0} == {i for i, _ in gone}
    assert 4 <= len(rows) - len(gone) < 100


def test_all_similar_pairs_of_whole_tables(spark):
    """Against all pairs of lines of the table, without fingerprints: nothing unlike is dropped, and of the similar pairs
    at least 0.9 end in one group."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = [(p, n) for p, n in lines_of(rows) if len(n) <= 3000]
    names = sorted({n for _, n in found})
    pairs = similar(names)
    want = groups(names, pairs)
    links = [(a, b) for a, b in candidates(names) if 1 - edit(a, b) / max(len(a), len(b)) >= 0.8 - 1e-12]
    got = groups(names, links)
    assert all(want[a] == want[b] for a, b in links)
    assert len(pairs) > 20 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_lines_of_one_bag_of_words(spark):
    """B and C are near, A has B's words in reverse: A in the table doesn't part them."""
    rng = np.random.default_rng(5)
    b = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(30)]
    c = list(b)
    c[10], c[20] = c[20], c[10]
    rows = [(1, " ".join(reversed(b))), (2, " ".join(b)), (3, " ".join(c))]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: ""}


def test_null_ids_are_told_apart_by_their_texts(spark):
    """A thousand null ids with a line of their own each, and one that all share."""
    rows = [(None, f"{'x' * (i % 7)}own{'abcdefghij'[i % 10] * 3}{chr(97 + i // 100) * 5}{chr(97 + i // 10 % 10) * 5} line\nthe line that they all share") for i in range(1000)]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), similarity=1.0).collect()
    own = sorted(r.text.split("\n")[0] for r in got)
    assert own == sorted(t.split("\n")[0] for _, t in rows) and sum("share" in r.text for r in got) == 1


def test_fingerprints():
    """Bits by majority over (word, occurrence); the order of words and what stands in other lines don't matter."""
    prints, ends, keys = ld.fingerprints([b"x y x z", b"z x y x", b"x y z", b""])
    assert prints[0] == prints[1] != prints[2] and prints[3] == 0
    assert keys[: ends[0]].tolist() == keys[ends[0] : ends[1]].tolist() and ends[2] == ends[3]
    many, ends, keys = ld.fingerprints([b"x y x z"] * 5 + [b"the of " * 900] * 2)
    assert set(many[:5].tolist()) == {int(prints[0])} and many[5] == many[6]


@pytest.mark.parametrize("words", [8, 40, 300, 4000])
def test_an_edited_word_leaves_keys(words):
    rng = np.random.default_rng(words)
    for _ in range(20):
        line = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(words)]
        near = list(line)
        near[int(rng.integers(words))] = "another"
        _, ends, keys = ld.fingerprints([" ".join(line).encode(), " ".join(near).encode()])
        assert set(keys[: int(ends[0])].tolist()) & set(keys[int(ends[0]) :].tolist())


def test_classes_follow_the_length():
    assert ld.classes_of(np.array([1, 63, 64, 127, 128, 255, 256, 10**6])).tolist() == [0, 0, 4, 4, 4, 4, 8, 16384]


def test_alignment_bounds_the_distance():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = [str(w) for w in rng.choice(["a", "bb", "ccc", "dd"], int(rng.integers(1, 12)))]
        b = [w for w in a if rng.random() < 0.8] + ["e"] * int(rng.integers(0, 2)) or ["f"]
        x, y = " ".join(a), " ".join(b)
        assert edit(x, y) <= ld.alignment_cost(x, y, 10**6)
    assert ld.alignment_cost("one two three four", "one three four", 99) == 4 and ld.alignment_cost("a b", "a b", 0) == 0


def test_edit_distance():
    rng = np.random.default_rng(7)

    def matrix(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
        return row[-1]

    for _ in range(500):
        a, b = ("".join(rng.choice(list("abc é"), int(n))) for n in rng.integers(0, 40, 2))
        assert ld.edit_distance(a, b) == edit(a, b) == matrix(a, b)
        for limit in (0.3, 0.8, 0.9):
            assert ld.similar(a, b, limit) == (edit(a, b) <= int(max(len(a), len(b)) * (1 - limit) + 1e-6))


def test_groups_that_share_a_bucket(spark):
    """Variants that are near their base, but not each other, and a second such group: pivots that fail lose no link."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(9)]
        for _ in range(40):
            own = list(base)
            own[int(rng.integers(9))] = word()
            rows.append((len(rows), " ".join(own)))
        rows += [(len(rows) + k, " ".join(base)) for k in range(2)]
    got = {r.doc_id for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_kept == 0}
    assert got == {i for i, _ in brute(rows)} and len(got) > 60


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "some words here\nmore"), (1, "some words here"), (2, "two\ntwo"), (2, "two\ntwo"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in ld.dedup_lines(df).collect() if r.text is not None)
    assert got == [(-1, "some words here\nmore"), (1, ""), (2, "two"), (2, "two"), (3, "")]
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_very_long_line_and_hot_line(spark):
    """A line of 200,000 words and a near copy of it; one line in every document, spread over many partitions."""
    rng = np.random.default_rng(8)
    long_ = rng.choice([f"w{i}" for i in range(5000)], 200_000)
    near = long_.copy()
    near[rng.integers(0, len(near), 300)] = "other"
    rows = [(0, " ".join(long_)), (1, " ".join(near)), *((i, f"the very common line of them all\nand {'abcdefghij'[i % 10] * 9} {'klmnopqrst'[i // 10 % 10] * 9} {'uvwxyzabcd'[i // 100] * 9}") for i in range(2, 800))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {r.doc_id: r.n_kept for r in ld.dedup_lines(df).collect()}
    assert got[0] == 1 and got[1] == 0 and got[2] == 2 and set(got[i] for i in range(3, 800)) <= {0, 1}


def test_names_that_results_have(spark):
    df = spark.createDataFrame([(1, "a b c\na b c", "x", 7)], "doc_id long, text string, n_lines string, N_KEPT int")
    out = ld.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "input_n_lines", "input_N_KEPT", "n_lines", "n_kept"]
    assert out.collect()[0][1:] == ("a b c", "x", 7, 2, 1)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in ld.op1_line_dedup(spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == kept_texts(rows, brute(rows))


def test_bitmap_without_room_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = ld.dedup_lines(docs).select("doc_id", "text").collect()
    monkeypatch.setattr(marks, "LEAST", 15)
    monkeypatch.setattr(marks, "MOST", 15)
    monkeypatch.setattr(ld, "REMEMBERED", 1)
    assert sorted(ld.dedup_lines(docs).select("doc_id", "text").collect()) == sorted(want)


def test_keys_are_shuffled_packed(spark):
    """Far fewer rows than keys; every bucket with several lines is found, with one of its lines as pivot."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, i, 0, t) for i, t in rows], "id long, s1 long, s2 long, text string").repartition(3)
    found = ld.Workspace(spark, "packed").keep(ld.occurrences(docs), "occurrences")
    names = sorted({n for _, n in lines_of(rows)})
    prints, ends, keys = ld.fingerprints([n.encode() for n in names])
    nodes = [int.from_bytes(ld.digest(n.encode())[:8], "little", signed=True) for n in names]
    want = {}
    for node, fp, start, end in zip(nodes, prints.view(np.int64).tolist(), [0, *ends[:-1].astype(int)], ends.astype(int)):
        for key in keys[start:end].view(np.int64).tolist():
            want.setdefault(key, set()).add((node, fp))
    want = {k: v for k, v in want.items() if len(v) > 1}
    got, pivots = {}, {}
    for r in ld.bucket_members(found).collect():
        got.setdefault(r.key, []).append((r.node, r.fp))
        pivots.setdefault(r.key, set()).add((r.pivot, r.pivot_fp, r["size"]))
    assert {k: set(v) for k, v in got.items()} == want and all(len(v) == len(want[k]) for k, v in got.items())
    assert all(len(p) == 1 and next(iter(p))[:2] in want[k] and next(iter(p))[2] == len(want[k]) for k, p in pivots.items())
    assert len(want) > 50 and 20 * ld.dealt_keys(found, 16).count() < len(keys)


def test_members_of_packed_keys():
    """Repeats of a line are counted, lines of one key only are left out, the line given most often is the pivot."""
    rows = [(1, 10, 5), (2, 20, 6), (1, 11, 7), (2, 20, 6), (1, 11, 7), (3, 30, 8), (1, 12, 9)]
    columns = [c.tolist() for c in ld.members_of(np.array(rows, np.uint64).tobytes())]
    assert sorted(zip(*columns)) == [(1, 10, 5, 1, 11, 7, 3), (1, 11, 7, 2, 11, 7, 3), (1, 12, 9, 1, 11, 7, 3)]
    assert ld.members_of(np.array(rows[1:2], np.uint64).tobytes()) == []


def test_common_subsequence_excludes_only_what_is_unlike():
    """Never a pair within the distance; lines of other words go without the edit matrix."""
    rng = np.random.default_rng(9)
    for _ in range(500):
        a = "".join(rng.choice(list("ab c"), int(rng.integers(0, 150))))
        b = "".join(x if rng.random() < 0.85 else str(rng.choice(["", "d", x + x])) for x in a)
        distance = edit(a, b)
        assert all(ld.may_be_within(a, b, most) for most in (distance, distance + 3, 2 * distance + 50))
    line = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(60))
    assert not any(ld.may_be_within(line(), line(), 84) for _ in range(20))


def test_normalised_texts_are_those_of_each():
    texts = [b" A  b\0c \n\n--\n1 x ", None, b"", b"\n", b"\0", "É  é".encode()]
    one = lambda t: [b" ".join(x.split()) for x in t.translate(ld._LINES).split(b"\n")] if t is not None else []
    assert ld.normalised_texts(texts) == [one(t) for t in texts] == [ld.normalised(t) for t in texts]
