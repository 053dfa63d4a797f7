"""What a document costs in op9_near_dedup, and that its draws stay as they are."""

import numpy as np
import xxhash

from verdure.llm import near


def test_usual_shingles_are_looked_up(monkeypatch):
    """op9: only shingles of an own weight are drawn anew for a text; the draws are those of every shingle drawn by itself."""
    rng = np.random.default_rng(4)
    sampler, made = near.Sampler(usual=2.5), []
    draws = sampler.draws
    monkeypatch.setattr(sampler, "draws", lambda row, weight: made.append(len(row)) or draws(row, weight))
    for n, own in ((1, 0), (1, 1), (40, 7), (400, 400), (3 * near.PART, 900)):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        # some stand at the same place of the table
        h[: n // 3] = (h[: n // 3] >> np.uint64(14) << np.uint64(14)) | np.uint64(77)
        h, weight = np.unique(h), np.full(len(np.unique(h)), 2.5)
        weight[rng.permutation(len(h))[:own]] = rng.uniform(0.5, 9, min(own, len(h)))
        got, anew = sampler.bands(h, weight), sum(made)
        made.clear()
        value, step = draws((h & np.uint64(near.TABLE - 1)).astype(np.int64), weight)
        at = value.argmin(0)
        x = (h[at] ^ step[at, np.arange(near.SAMPLES)].astype(np.int64).astype(np.uint64) * near._BASE).reshape(near.BANDS, near.ROWS)
        key = np.arange(near.BANDS, dtype=np.uint64)
        for i in range(near.ROWS):
            key = (key + x[:, i]) * near._MIX
            key ^= key >> np.uint64(29)
        assert got.tolist() == key.view(np.int64).tolist() and anew == np.sum(weight != 2.5)


def test_shingles_of_words():
    words = "Über den Dächern der alten STADT der alten stadt der alten stadt".lower().split()
    each = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    assert near.word_hashes(words).tolist() == each and near.word_hashes([]).tolist() == []
    assert near.shingle_hashes(" ".join(words).upper()).tolist() == near.shingle_hashes(words).tolist()
    h, n = near.distinct(near.shingle_hashes(words))
    want = np.unique(near.shingle_hashes(words), return_counts=True)
    assert h.tolist() == want[0].tolist() and n.tolist() == want[1].tolist() and max(n) > 1
    assert [len(x) for x in near.distinct(near.shingle_hashes(""))] == [0, 0] and len(near.shingle_hashes("a b")) == 1
