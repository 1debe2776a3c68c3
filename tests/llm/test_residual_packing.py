import random
import zlib

import numpy as np
import public_tokenizers
from common import ODD, empty, frame

from stayframe.llm import residual_packing
from stayframe.llm.word_tokens import WordEncoder
from stayframe.session import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


def fills(rows, window):
    """Tokens in each sequence, after checking that its pieces lie there one after another."""
    parts = {}
    for r in rows:
        parts.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in parts.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return sorted(sum(n for _, n in own) for own in parts.values())


def test_best_fit_takes_the_tightest_space():
    rng = random.Random(8)
    lengths = [rng.randint(1, 64) for _ in range(500)]
    number, place = residual_packing.best_fit(np.array(lengths), 64)
    free = []
    for length in sorted(lengths, reverse=True):  # the same by looking at all windows
        fits = [c for c in free if c >= length]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 64) - length)
    assert sorted(64 - np.bincount(number, weights=lengths).astype(int)) == sorted(free)
    assert (place[np.unique(number, return_index=True)[1]] >= 0).all()


def test_pieces_of_odd_rows(spark):
    for window, group in ((64, 3), (64, 1000), (4096, 2)):
        found = residual_packing.pack_documents(frame(spark), WORDS, 1, window=window, group=group, with_ids=True)
        assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
        rows = found.collect()
        fills(rows, window)
        for i, text in {r[0]: r[1] for r in ODD}.items():
            ids = np.append(np.frombuffer(WordEncoder(WORDS).whole([text or ""])[0], "<u4"), 1).astype("<u4")
            want = [(p, p * window, ids[p * window : (p + 1) * window]) for p in range(-(-len(ids) // window))]
            got = sorted((r["piece"], r["start"], r["ids"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
            copies = 2 if i == 7 else 1
            assert got == sorted((p, a, x.tolist(), len(x), zlib.crc32(x.tobytes())) for p, a, x in want * copies)
    assert residual_packing.pack_documents(empty(spark), WORDS, 1).collect() == []


def packed(spark, lengths, window, group):
    place = scratch_path(spark, "lengths")
    spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").selectExpr("*", "0 as `a.b`").repartition(3).write.parquet(place)
    rows = residual_packing.pack(spark.read.parquet(place), window=window, group=group).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    return fills(rows, window)


def test_residues_are_merged_up_the_tree(spark):
    rng = random.Random(9)
    mixed = [min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(1500)]
    sums = packed(spark, mixed, 100, 60)
    # 25 groups alone leave windows open each; merged, hardly more is left than by one task.
    assert len(sums) <= 1.02 * len(packed(spark, mixed, 100, 10_000))
    # The last task saw all that was left open: no two of these fit together.
    assert sums[0] + sums[1] > 100
    # Nothing joins, however many rounds there are; and whole windows stay alone.
    assert packed(spark, [51] * 60, 100, 20) == [51] * 60
    assert packed(spark, [100] * 30 + [1] * 100, 100, 30) == [100] * 31
