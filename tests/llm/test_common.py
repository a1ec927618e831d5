import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.llm.common import components, slices, split_words, window_hashes, word_hashes
from tests.llm.helpers import WORD, least_reachable, lower


def test_words_of_slices():
    texts = [None, "", " A\x0bB\x0cc\x1cD\x1fe  F g\r\n", "É É é", "x" * 40] * 300 + [f"Doc {i} Word{i % 7}" for i in range(2000)]
    whole = pa.array(texts, pa.string())
    for part in (whole, whole.slice(777), whole.slice(1503, 211), whole.slice(5, 0)):
        for low in (False, True):
            off, words = split_words(part, low)
            want = [WORD.findall(lower(t) if low else t or "") for t in part.to_pylist()]
            assert words.to_pylist() == [w for r in want for w in r]
            assert np.diff(off).tolist() == [len(r) for r in want]
    got = [b.column(0).to_pylist() for b in slices(iter([pa.record_batch([whole], ["t"])]), "t", 1000)]
    assert [t for part in got for t in part] == texts and len(got) > 5


def test_hashes_depend_on_the_words_alone():
    rng = np.random.default_rng(0)
    words = ["", *{"".join(chr(c) for c in rng.integers(97, 123, rng.integers(1, 40))) for _ in range(3000)}][1:]
    words += ["a" * n for n in range(1, 60)] + ["é" * n for n in range(1, 20)] + ["\0", "\0\0", "a\0"]
    words = list(dict.fromkeys(words))
    h = word_hashes(pa.array(words, pa.large_string()))
    assert len(np.unique(h)) == len(words)
    part = word_hashes(pa.array(words, pa.large_string()).slice(100, 50))
    assert (part == h[100:150]).all()
    assert len(window_hashes(h, 0)) == 0 and len(window_hashes(h, len(h))) == 1
    assert (window_hashes(h[10:30], 5) == window_hashes(h, 5)[10:26]).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (230, 2))] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(2000 + i, 2001 + i) for i in range(60)] + [(-5, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ids = sorted({x for e in edges for x in e})
    linked = {frozenset(e) for e in edges}
    want = dict(zip(ids, least_reachable(ids, lambda i, j: frozenset((ids[i], ids[j])) in linked)))
    assert got == {x: want[x] for x in ids if any(x in e and len(e) > 1 for e in linked)}
    none = spark.createDataFrame([], "u long, v long")
    assert components(none).count() == 0 and components(none.withColumn("v", F.col("u"))).columns == ["node", "component"]


IDLE_MB = """
import re, sys
from types import SimpleNamespace as N
import numpy as np, pyarrow as pa
import public_tokenizers as P
from fathom.llm import bpe, jaccard_join, lang_id
from fathom.llm.common import window_hashes

def mb():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

class Tasks(list):  # takes what is given to mapInArrow
    schema, sparkSession = [], N(sparkContext=N(broadcast=lambda v: N(value=v)))
    def mapInArrow(self, run, schema):
        self.append(run)

words = np.array([f"w{i:05d}" for i in range(50_000)])
rng = np.random.default_rng(1)
def batches(n=20):
    for _ in range(n):
        yield pa.record_batch([pa.array([" ".join(rng.choice(words, 1500)) for _ in range(400)])], ["text"])

df = Tasks()
if sys.argv[1] == "sets":
    jaccard_join._sets(df, "text", 5, lambda s: (s.view(np.int64),), "s array<long>", [("s", pa.list_(pa.int64()))], [])
else:
    samples = {l: [" ".join(rng.choice(words[:9], 99)).encode() for _ in range(9)] for l in "abcd"}
    lang_id.predict(df, lang_id.ContextTrees.fit(samples), limits=lang_id.letter_limits(samples))
for _ in df[0](batches(1)):
    pass
import gc; gc.collect(); pa.default_memory_pool().release_unused()
start = mb()
for _ in df[0](batches(6)):
    pass
del _
print(mb() - start)
"""


@pytest.mark.parametrize("task", ["sets", "lang"])
def test_an_idle_worker_gives_back_the_memory_of_its_tasks(task):
    got = subprocess.run([sys.executable, "-c", IDLE_MB, task], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert float(got.stdout) < 6
