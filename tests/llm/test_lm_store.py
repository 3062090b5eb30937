"""The language model's store: many parts in few files, few of them open, fetched parts bounded."""

import os

import numpy as np
import pytest

from spoor.llm import ngram_lm
from spoor.llm.ngram_lm import Store, _table

PARTS, FILES = 10_000, 500


def rows_of(part: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(part)
    return np.unique(made.integers(0, 2**63, 1 + part % 7, dtype=np.uint64)), np.arange(part, part + 4, dtype=np.uint64)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('store')}/arrays"
    store = Store(path, FILES)
    for k in range(FILES):
        with store.writer() as out:
            for part in range(k, PARTS, FILES):
                if part % 11:
                    key, values = rows_of(part)
                    out.put("ngram", part, _table(key, np.tile(values, (len(key), 1))))
    return path


def open_files(path: str) -> int:
    with open("/proc/self/maps") as f:
        return len({line.split()[-1] for line in f if path in line})


@pytest.mark.parametrize("fetched", [False, True])
def test_many_parts_in_few_open_files(folder, fetched):
    assert len(os.listdir(folder)) == FILES
    store = Store(folder, FILES)
    if fetched:
        store.local = None
    held = [rows_of(p) for p in range(PARTS)]
    part = np.concatenate([np.full(len(k), p) for p, (k, _) in enumerate(held)])
    key = np.concatenate([k for k, _ in held])
    want = np.concatenate([np.tile(v if p % 11 else v * np.uint64(0), (len(k), 1)) for p, (k, v) in enumerate(held)])
    shuffled = np.random.default_rng(1).permutation(len(key))
    got = store.find("ngram", 4, part[shuffled], key[shuffled])
    assert (got == want[shuffled]).all()
    assert len(store.open) <= Store.OPEN < 100
    assert fetched or 0 < open_files(folder) <= Store.OPEN
    assert not store.find("ngram", 4, np.array([PARTS + 3]), key[:1]).any()
    assert not store.find("context", 4, np.array([3]), key[:1]).any()


def test_fetched_parts_are_bounded_and_found_again(folder, monkeypatch):
    monkeypatch.setattr(Store, "SPOOL", 2_000)
    store = Store(folder, FILES)
    store.local = None
    most = 0
    for part in [*range(1, 3_000, 7), *range(1, 3_000, 7)]:
        key, values = rows_of(part)
        got = store.find("ngram", 4, np.full(len(key), part), key)
        assert (got == (values if part % 11 else 0)).all()
        most = max(most, sum(x.spooled for x in store.open.values() if x is not None))
    assert 0 < most <= 2_000


def test_a_task_that_fails_leaves_no_file_and_one_that_runs_again_leaves_the_same(tmp_path):
    store = Store(f"{tmp_path}/again", 3)

    def task(fail: bool) -> None:
        with store.writer() as out:
            for part in (1, 4, 7):
                key, values = rows_of(part)
                out.put("ngram", part, _table(key, np.tile(values, (len(key), 1))))
                if fail and part == 4:
                    raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        task(True)
    assert Store(store.path, 3).get("ngram", 1) is None
    task(False)
    first = open(f"{store.path}/ngram-1", "rb").read()
    task(False)
    assert open(f"{store.path}/ngram-1", "rb").read() == first
    assert Store(store.path, 3).get("ngram", 7).n == len(rows_of(7)[0])


def test_training_writes_a_file_a_task_and_kind(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "PART_TOKENS", 20)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(40))) for i in range(60)], "doc_id long, text string")
    model = ngram_lm.train(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert model.layout.parts > 4 * n
    assert len(os.listdir(model.store.local)) <= 6 * n
    assert ngram_lm.score(docs, model).where("score < 0").count() == 60
