"""What the driver plans with doesn't grow with the rounds of an iteration."""

import random
import re
from pathlib import Path

from cohortspark.llm import common, graphs, jaccard_join


def digits(df):
    """About how many the size in bytes has that Spark plans with, 18 at least."""
    beyond = re.search(r"E\+(\d+)", df._jdf.queryExecution().optimizedPlan().stats().simpleString())
    return int(beyond[1]) if beyond else 18


def chain(n, seed):
    ids = random.Random(seed).sample(range(10**9), n)
    return list(zip(ids[:-1], ids[1:]))


def test_planned_sizes_of_components_stay_small(spark):
    """Joins multiply estimates, so those of a table that is only cut off by checkpoints double their digits with each join."""
    edges = chain(25, 1) + chain(40, 2)
    found = graphs.components(spark.createDataFrame(edges, "a long, b long"))
    assert digits(found) == 18
    roots = {x.root for x in found.collect()}
    assert len(roots) == 2 and found.count() == 65


def test_planned_sizes_of_tables_made_for_the_next_step(spark, documents, monkeypatch):
    """A chain of texts, each near its neighbours, in a region that is cut again, so that one search for components starts from
    what another one found."""
    sizes = []
    for module in (graphs, jaccard_join):
        for name in ("checkpointed", "written"):

            def spied(df, *rest, old=getattr(module, name, None)):
                out = old(df, *rest)
                sizes.append(digits(out[0] if isinstance(out, tuple) else out))
                return out

            if hasattr(module, name):
                monkeypatch.setattr(module, name, spied)
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 80])) for i in range(30)]
    got = jaccard_join.jaccard_components(documents(rows), 3, 90, leaf_sets=5, pivots=3).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, 78, 0) for i in range(30)}
    assert max(sizes) < 60


def test_rounds_leave_no_files(spark):
    graphs.components(spark.createDataFrame(chain(25, 3), "a long, b long"))
    graphs.components(spark.createDataFrame([], "a long, b long"))
    assert not list(Path(common.shared_dir(spark).removeprefix("file:")).glob("edges-*"))
