import pytest

from featsel.llm import minhash_dedup as m


@pytest.mark.parametrize("size", [m.SIZE, m.LONG])
def test_loss_over_all_looks(size):
    least = m.fewest_matches(75, size=size)
    alive = {0: 1.0}  # matches so far -> probability, hash by hash
    for n in range(1, size + 1):
        new = {}
        for k, p in alive.items():
            new[k] = new.get(k, 0) + p * 0.25
            new[k + 1] = new.get(k + 1, 0) + p * 0.75
        alive = {k: p for k, p in new.items() if n % m.BATCH or k >= least[n // m.BATCH - 1]}
    assert 0 < 1 - sum(alive.values()) <= m.MISS


def test_other_percentages_end():
    for percent in (1, 50, 90, 99):
        assert m.pruned(m.fewest_matches(percent), percent / 100) <= m.MISS
