import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from common import ODD, empty, frame
from conftest import rows
from hypothesis import given, settings, strategies as st

from stayframe.llm import collocations, lexical_search

LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    """Scores of all documents by the formula, as sorted lists of (rank, doc_id, score) in the items' order."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    frequency = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, count), n in zip(held, sizes):
            score = 0
            for t in terms(text):
                if t in count:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                    score += w * (10**9 * count[t] // (1000 * count[t] + 12 * (75 + 25 * n * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def test_search_ranks_odd_rows(spark):
    docs = [(r[0], r[1]) for r in ODD]
    items = [(1, "The DOG, the dog!"), (1, "two words two"), (2, None), (3, ""), (4, "日本語 naïve"), (None, "nowhere words x9"), (5, "unheard")]
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as score", "2 as doc_id", "3 as rank")
    want = ranked(docs, items, 3)
    for options in ({}, {"segment": 2, "item_bytes": 8}, {"postings": 1}):
        assert rows(lexical_search.search(frame(spark), asked, k=3, **options)) == want
    assert rows(lexical_search.search(empty(spark), asked)) == []
    assert rows(lexical_search.search(frame(spark), asked.where("item_id < 0"))) == []


def test_search_skips_nothing_it_needs(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(draw.choices(words, [40 / (j + 1) for j in range(40)], k=draw.randint(0, 60)))) for i in range(700)]
    docs += [(1000 + i, t) for i, t in docs[:200]]  # ties
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 30)))) for i in range(12)]
    kinds = "doc_id bigint, text string"
    made = spark.createDataFrame(docs, kinds).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    for k, segment in ((1, 10_000), (20, 10_000), (7, 50)):
        assert rows(lexical_search.search(*made, k=k, segment=segment)) == ranked(docs, items, k)


def test_blocks_out_of_reach_are_left_out():
    """One document is far better than all others: only its block is walked after the short list."""
    docs = np.concatenate([np.arange(1000), [700]]).astype("<i4")
    repeats = np.ones(1001, np.int64)
    segment = lexical_search.Segment(np.full(1000, 10), np.array([0, 1]), np.array([1000, 1]), docs, repeats, 1000, 10_000)
    assert segment.top([0, 1], [1, 5_000], 1)[0][1] == 700
    assert len(segment.top([0], [1], 20)) == 20 and sorted(p for _, p in segment.top([0], [1], 20)) == list(range(20))


BREAK, WORD = re.compile(r"[.,;:!?\x0a-\x0d]"), re.compile(r"[^\x20\x09]+")


def pieces(text):
    return [p for p in (WORD.findall(x) for x in BREAK.split((text or "").translate(LOWER))) if p]


def phrases(docs, least, most_words, top, covered=100):
    """The operator's rule, spelled out over all runs of words."""
    count, whole, out = defaultdict(Counter), Counter(), []
    for lang, text in docs:
        for words in pieces(text):
            whole[lang or "und"] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    count[lang or "und"][tuple(words[i : i + k])] += 1
    for lang, all_f in count.items():
        often = {p: f for p, f in all_f.items() if f >= least}
        kept = []
        for p, a in often.items():
            longer = [q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if len(p) == 1 or any(100 * often[q] >= covered * a for q in longer):
                continue
            score, _, left, right = min((1000 * a * whole[lang] // (often[p[:k]] * often[p[k:]]), k, often[p[:k]], often[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, x, y, whole[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def test_phrases_of_odd_rows(spark):
    draw = random.Random(5)
    made = [(i, draw.choice(["a  B c", "a b. c d", "a b c d e f", "x\ty z!", "A b", "日 本 語 a b"]) * draw.randint(0, 3), draw.choice(["en", "de", None])) for i in range(80)]
    odd = [(r[0], r[1], r[2], r[3], r[4]) for r in ODD] + [(i, t, lang, "z", 1) for i, t, lang in made]
    docs = [(r[2], r[1]) for r in odd]
    for least, most, top, covered in ((3, 5, 50, 100), (2, 3, 4, 60), (4, 2, 1000, 100)):
        for bits in (27, 16):
            found = collocations.collocations(frame(spark, odd).repartition(3), least=least, most_words=most, top=top, covered=covered, most_bits=bits)
            assert rows(found.drop("words", "doc_id")) == phrases(docs, least, most, top, covered)
    assert rows(collocations.collocations(empty(spark))) == []
    first = collocations.collocations(frame(spark, odd), least=3).select("phrase", "doc_id").first()
    assert any(i == first["doc_id"] and first["phrase"].split(" ")[0] in (t or "").translate(LOWER) for i, t, *_ in odd)


TEXTS = st.lists(st.text(st.sampled_from("aB .,\n\t\x0bé"), max_size=30), min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 40), st.integers(1, 5))
def test_words_in_parts_are_the_words_of_the_texts(texts, at_once, most_words):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want, got = Counter(), Counter()
    for i, text in enumerate(texts):
        for words in pieces(text):
            want.update((i, *words[a : a + k]) for k in range(1, most_words + 1) for a in range(len(words) - k + 1))
    for w in collocations.words_of(data, offsets, most_words, at_once):
        each = [data[a:b].tobytes().decode().translate(LOWER) for a, b in zip(w.begins, w.ends)]
        for k in range(1, most_words + 1):
            for a in range(max(0, w.seen - k + 1), len(each) - k + 1):
                if len(set(w.piece[a : a + k])) == 1 and len(set(w.text[a : a + k])) == 1:
                    got[(int(w.text[a]), *each[a : a + k])] += 1
        known = defaultdict(set)
        for text, h in zip(each, w.hashes.tolist()):
            known[text].add(h)
        assert all(len(h) == 1 for h in known.values())
    assert got == want


def test_equal_fingerprints_of_unlike_words_are_told_apart():
    text = b"one two one six ten two"
    begins = np.array([0, 4, 8, 12, 16, 20])
    words = collocations.Words(np.array([7, 7, 7, 7, 9, 7], np.uint64), begins, begins + 3, np.zeros(6, int), np.zeros(6, int))
    ids = collocations._word_ids(np.frombuffer(text, np.uint8), words)
    assert len(set(ids)) == 4 and ids[0] == ids[2] and ids[1] == ids[5]
    at, counts = collocations._distinct(ids, np.full(6, 1, np.uint64), np.arange(6), 1)
    assert sorted(zip(ids[at].tolist(), counts.tolist())) == sorted(Counter(ids.tolist()).items())
    at, counts = collocations._distinct(np.array([1, 2, 1, 2, 3, 1, 2]), np.array([5, 5, 5, 6], np.uint64), np.array([0, 2, 4, 5]), 2)
    assert sorted(zip(at.tolist(), counts.tolist())) == [(0, 2), (4, 1), (5, 1)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 1000)), st.one_of(st.integers(1, 300), st.integers(1, 2**40)), min_size=1, max_size=50))
def test_packed_runs_come_back(counts):
    prints = np.array(sorted(counts), np.uint64)
    many = np.array([counts[int(x)] for x in prints], np.int64)
    back = collocations.unpack_run(collocations.pack_run(prints, many))
    assert (back[0] == prints).all() and (back[1] == many).all()
