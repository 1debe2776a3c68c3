import hashlib
import random
import re

import pytest
from common import ODD, components_of, empty, frame

from stayframe.llm import digest_index, fingerprints, hamming_join, line_dedup
from stayframe.llm.components import components
from stayframe.llm.digest_index import DigestIndex, add_batch, exact_dedup
from stayframe.session import scratch_path


def near_texts(seed, groups=12, copies=6, noise=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 160))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // noise))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("size,num", [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(spark, size, num):
    texts = near_texts(size)
    rows = [(i, t, None, None, None) for i, t in texts]
    expected = components_of(texts, size, num, 100)
    # Tiny blocks take the path of very large keys.
    for block in (1024, 2):
        found = hamming_join.near_duplicates(frame(spark, rows), size=size, num=num, block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == expected
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    banded = fingerprints.linked(frame(spark, rows), size=size, num=num).collect()
    assert {r["doc_id"]: r["component_id"] for r in banded} == expected


def test_near_duplicates_of_odd_rows(spark):
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in hamming_join.near_duplicates(frame(spark)).collect()]
    assert len(found) == len(ODD)
    by_id = {r[0]: r for r in found}
    assert by_id[1][2] == by_id[2][2] == by_id[3][2] == 1 and not by_id[2][3]
    for i in (4, 5, 6):
        assert by_id[i] == (i, 0, i, True)
    assert by_id[7][1] == 1 and by_id[None][2] is None and by_id[None][3]
    assert found.count((7, 1, 7, True)) == 2
    assert hamming_join.near_duplicates(empty(spark)).collect() == []


def test_spanning_links_skip_only_what_is_connected():
    import numpy as np

    base = np.arange(100, dtype=np.uint64)
    sets = [base, base[:95], base[5:], np.arange(1000, 1100, dtype=np.uint64), base[:50]]
    links = hamming_join.spanning_links(np.array([7, 3, 9, 5, 1]), sets, 85, 100)
    assert {frozenset(x) for x in links} == {frozenset((7, 3)), frozenset((7, 9))}
    sides = np.array([0, 0, 1, 1, 1])
    assert {frozenset(x) for x in hamming_join.spanning_links(np.array([7, 3, 9, 5, 1]), sets, 85, 100, sides)} >= {frozenset((7, 9))}


def test_pairs_far_below_the_usual_similarity_are_found(spark):
    rows = []
    for i in range(60):  # 69 words shared of 131: just above a half
        rows += [(2 * i, " ".join(f"w{i}x{k}" for k in range(100)), None, None, None)]
        rows += [(2 * i + 1, " ".join(f"w{i}x{k}" for k in range(31, 131)), None, None, None)]
    found = hamming_join.near_duplicates(frame(spark, rows), size=1, num=50).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i - i % 2 for i in range(120)}


@pytest.mark.parametrize("num", [50, 70, 80, 85, 90])
def test_layouts_miss_less_than_they_say(num):
    import numpy as np

    layout, rng = hamming_join.layout_for(num, 100), np.random.default_rng(num)
    a = rng.integers(0, 2**16, (50_000, layout.slots), np.uint16)
    b = np.where(rng.random(a.shape) < num / 100, a, a ^ 1)
    hits = sum(hamming_join.within_reach(a, b, np.full(len(a), w), layout) for w in range(layout.slots))
    assert layout.misses(num / 100) <= 1e-6 and (hits <= 1).all() and (hits == 0).sum() <= 1
    some = slice(0, 2000)
    shared = hamming_join.chunk_keys(a[some], layout) == hamming_join.chunk_keys(b[some], layout)
    assert (shared.any(1) >= (hits[some] == 1)).all()


def test_similarities_beyond_all_layouts_are_refused():
    for num in (0, 30, 101):
        with pytest.raises(ValueError):
            hamming_join.layout_for(num, 100)


def test_signature_distance_is_met_by_a_key():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (500, hamming_join.SLOTS), np.uint16)
    b = a.copy()
    for row in b:  # exactly REACH slots differ, anywhere
        at = rng.choice(hamming_join.SLOTS, hamming_join.REACH, replace=False)
        row[at] ^= 1
    ka, kb = hamming_join.chunk_keys(a), hamming_join.chunk_keys(b)
    assert ((ka == kb).any(1)).all()
    hits = sum(hamming_join.within_reach(a, b, np.full(500, w)) for w in range(hamming_join.SLOTS))
    assert (hits == 1).all()  # each pair is met under one of its keys only


@pytest.mark.parametrize("num", [50, 60, 70, 80, 85, 90, 95])
def test_every_distance_within_reach_is_met_by_a_key(num):
    import numpy as np

    layout, rng = hamming_join.layout_for(num, 100), np.random.default_rng(num)
    a = rng.integers(0, 2**16, (1500, layout.slots), np.uint16)
    b = a.copy()
    for row in b:  # up to ``reach`` slots differ, anywhere
        at = rng.choice(layout.slots, rng.integers(layout.reach // 2, layout.reach + 1), replace=False)
        row[at] ^= 1
    ka, kb = hamming_join.chunk_keys(a, layout), hamming_join.chunk_keys(b, layout)
    assert (ka == kb).any(1).all()
    hits = sum(hamming_join.within_reach(a, b, np.full(len(a), w), layout) for w in range(layout.slots))
    assert (hits == 1).all()


def test_units_are_bounded_in_bytes(spark, monkeypatch):
    texts = near_texts(31, groups=4, copies=12)
    monkeypatch.setattr(hamming_join, "BLOCK_BYTES", 2000)  # a few sets
    found = hamming_join.near_duplicates(frame(spark, [(i, t, None, None, None) for i, t in texts])).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == components_of(texts, 3, 85, 100)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(60)] + [(5, 5)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(50):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == label
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def strip(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_of_odd_rows(spark):
    found = exact_dedup(frame(spark)).collect()
    assert len(found) == len(ODD)
    groups = {}
    for row in ODD:
        groups.setdefault(strip(row[1]), []).append(row)
    for r in found:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        best = min(groups[text], key=lambda x: (-len(x[1] or ""), x[0] is None, x[0]))
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best[0], len(groups[text]), r["doc_id"] == best[0])
    assert {r["keep_id"] for r in found if r["doc_id"] in (1, 2, 3)} == {3}
    assert exact_dedup(empty(spark)).collect() == []


def test_index_outlives_its_session_name(spark):
    path = scratch_path(spark, "index")
    first = DigestIndex(spark, path, 4)
    one = add_batch(first, frame(spark, ODD[:1])).collect()
    assert one[0]["kept"]
    first.close()
    again = DigestIndex(spark, path, 4)
    two = {r["doc_id"]: r for r in add_batch(again, frame(spark, ODD[1:])).collect()}
    # The text came with an earlier batch, so its row stays and none of these does.
    assert two[2]["keep_id"] == two[3]["keep_id"] == 1 and not two[2]["kept"] and not two[3]["kept"]
    assert two[8]["kept"] and again.rows().count() == len({strip(r[1]) for r in ODD})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def expected_drops(rows, least):
    places = [(i, n, line) for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]) for n, line in enumerate((t or "").split("\n"))]
    first = {}
    for i, n, line in places:
        if line.strip(" "):
            first.setdefault(line, (i, n))
    near = {a for a in first for b in first if len(a) >= least and len(b) >= least and first[b] < first[a] and one_edit(a, b)}
    out = {i: [] for i, _, _ in places}
    for i, n, line in places:
        if line.strip(" ") and (line in near or first[line] != (i, n)):
            out[i].append(n)
    return out


def test_repeated_lines_match_all_pairs(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 26))) for _ in range(60)]
    for line in list(lines):
        for _ in range(2):
            at = rng.randrange(len(line) + 1)
            lines += [line[:at] + rng.choice("abcé日") + line[at + rng.randint(0, 1) :], line[:at] + line[at + 1 :]]
    lines += ["number line %02d of many" % i for i in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(8)), None, None, None) for i in range(1, 60)]
    expected = expected_drops(rows, 12)
    found = line_dedup.repeated_lines(frame(spark, rows))
    assert {r["doc_id"]: r["dropped_lines"] for r in found.collect()} == expected
    texts = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(frame(spark, rows), found).collect()}
    for i, text, *_ in rows:
        assert texts[i] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in expected[i])


def test_repeated_lines_of_odd_rows(spark):
    found = line_dedup.repeated_lines(frame(spark)).collect()
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["dropped_lines"] == [] and by_id[2]["dropped_lines"] == [0]
    assert by_id[3]["dropped_lines"] == [0]  # one space more is one edit
    assert by_id[4]["n_lines"] == by_id[5]["n_lines"] == 1 and by_id[6]["dropped_lines"] == []
    assert by_id[8]["dropped_lines"] == list(range(1, 4000)) and by_id[None]["dropped_lines"] == []
    assert line_dedup.repeated_lines(empty(spark)).collect() == []


def test_neighbours_of_odd_rows(spark):
    rows = [r for r in ODD if r[0] not in (7, None)]
    for partitions in (1, 5):
        found = {r["doc_id"]: r for r in fingerprints.compare_neighbours(frame(spark, rows), partitions=partitions).collect()}
        order = sorted(rows, key=lambda r: -r[0])
        assert len(found) == len(rows)
        for row, after in zip(order, order[1:] + order[:1]):
            text, following, r = row[1] or "", after[1] or "", found[row[0]]
            half = len(text) // 2
            changed = text[: len(text) - half] + following[:half]
            assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert 0 <= r["near_edited"] <= 1 and (r["near_next"] == 1) >= (text == following)
        assert found[1]["fingerprint"] == found[2]["fingerprint"] and found[2]["near_next"] == 1
    single = fingerprints.compare_neighbours(frame(spark, ODD[:1])).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1
    assert len(fingerprints.compare_neighbours(frame(spark)).collect()) == len(ODD)
    assert fingerprints.compare_neighbours(empty(spark)).collect() == []


def test_likeness_estimates_similarity():
    import pyarrow as pa
    from common import shingles

    texts = [t for _, t in near_texts(9, groups=4)]
    prints, some = fingerprints.text_fingerprints(pa.array(texts), 5)
    for i in range(len(texts)):
        for j in range(len(texts)):
            a, b = shingles(texts[i], 5), shingles(texts[j], 5)
            found = fingerprints.likeness(prints[i : i + 1], prints[j : j + 1], some[i : i + 1], some[j : j + 1])[0]
            assert abs(found - len(a & b) / len(a | b)) < 0.25


def test_digest_module_is_native():
    import inspect

    text = inspect.getsource(digest_index)
    assert not re.search(r"pandas|pyarrow|udf|mapIn|\.rdd", text)
