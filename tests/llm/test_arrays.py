"""Exact keys of n-grams at any vocabulary size, and copies of arrays that a machine's workers share."""

import os
import subprocess
import sys

import numpy as np
import pytest

from auralake.llm import lm
from auralake.llm.arrays import Copies, SharedArrays


@pytest.mark.parametrize("types", [5, 1 << 20, (1 << 21) + 1, 1 << 33, (1 << 40) - 1])
@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_keys_are_exact_and_sorted(types, n):
    model = lm.Model(SharedArrays("file:///tmp/none"), order=n, types=types)
    r = np.random.RandomState(1)
    words = [np.concatenate([r.randint(0, types, 500), [0, types, types, 0]]) for _ in range(n)]
    words[-1][-2:] = [0, types]
    key = model.key(words)
    assert all((a == b).all() for a, b in zip(model.words_of(key, n), words, strict=True))
    rows = lm._to_rows(key)
    back = model.from_rows(__import__("pandas").Series(rows), n)
    assert (back == key).all()
    order = sorted(range(len(key)), key=lambda i: tuple(w[i] for w in words))
    assert [tuple(w[i] for w in words) for i in order] == [tuple(w[i] for w in words) for i in sorted(range(len(key)), key=lambda i: rows[i])]
    known = np.sort(key)
    assert (known[np.searchsorted(known, key)] == key).all()
    assert len(np.unique(key)) == len({tuple(w[i] for w in words) for i in range(len(key))})


def test_the_number_of_tasks_grows():
    assert lm._bits(1 << 40, lm.GRAM_SHARD, lm.MAX_GRAM_BITS) == 12 and lm._bits(300 << 19, lm.GRAM_SHARD, lm.MAX_GRAM_BITS) == 9 and lm._bits(5, lm.GRAM_SHARD, lm.MAX_GRAM_BITS) == 0


def test_workers_share_copies(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    monkeypatch.setattr("tempfile.tempdir", None)
    code = "import sys, time; sys.path.insert(0, sys.argv[1]); from auralake.llm.arrays import Copies; c = Copies('store://x'); c.get('a', lambda p: (time.sleep(0.2), open(p, 'w').write('z'), print('fetched'))); print('ready', flush=True); sys.stdin.read()"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    workers = [subprocess.Popen([sys.executable, "-c", code, root], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True) for _ in range(3)]
    mine = Copies("store://x")
    said = [[], [], []]
    for w, s in zip(workers, said, strict=True):
        while "ready" not in s:
            s.append(w.stdout.readline().strip())
    assert sum("fetched" in s for s in said) == 1
    assert open(mine.get("a", lambda p: pytest.fail("fetched again"))).read() == "z"
    for w in workers:
        w.communicate("")
    assert os.path.exists(f"{mine.root}/a")  # this worker maps it still
    mine.leave()
    assert not os.path.exists(mine.root)
