"""Working contexts against a plain dict."""

import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.operators import contexts as C

OPS = "project string, seq long, op string, text string"


def plain(held, ops):
    """(results, contexts by project) of one operation after the other."""
    state, out = dict(held), []
    for project, seq, op, text in sorted(ops, key=lambda o: o[1]):
        text, now = text or "", state.get(project)
        if not (project or "").strip() or project == "__global__":
            out.append((project, seq, "no_project", None))
            continue
        outcome = op
        if op == "clear":
            outcome = "cleared" if state.pop(project, None) else "absent"
        elif op == "set" or op == "append":
            new = text
            if op == "append":
                base = now[0] if now else ""
                n = max((int(m) for m in re.findall(r"(?m)^## Ammendment +(\d+)\s*$", base)), default=0) + 1
                new = base + ("" if not base or base.endswith("\n\n") else "\n" if base.endswith("\n") else "\n\n") + f"## Ammendment {n}\n{text}"
            if len(new) > 65_536:
                outcome = "too_long"
            else:
                state[project] = (new, (now[1] if now else 0) + 1)
        else:
            outcome = "unknown"
        out.append((project, seq, outcome, state[project][1] if project in state else None))
    return sorted(out, key=str), state


def test_operations_equal_a_plain_fold(spark):
    draw = random.Random(6)
    held = {"p1": ("base\n\n## Ammendment 7\nx", 3), "p2": ("## Ammendment 2 \n\n", 1), "other": ("stays", 9), "full": ("y" * 65_530, 1)}
    texts = ["a", "b\n", "", None, "c\n\n", "## Ammendment 40\nin the text", "é" * 20]
    ops = [(draw.choice(["p1", "p2", "p3", "full", "", None, "__global__"]), k, draw.choice(["append", "append", "append", "set", "clear", "jump"]), draw.choice(texts)) for k in range(160)]
    contexts = schemas.conform(spark.createDataFrame([(p, c, v, datetime(2024, 1, 1)) for p, (c, v) in held.items()], "project string, content string, version long, updated_at timestamp"), "working_context")
    results, after = C.change_contexts(contexts, spark.createDataFrame(ops, OPS).repartition(3), F.lit(datetime(2024, 6, 1)))
    want, state = plain(held, ops)
    assert sorted((tuple(r) for r in results.collect()), key=str) == want
    got = {r["project"]: (r["content"], r["version"]) for r in after.collect()}
    assert got == state
    assert {r["updated_at"].month for r in C.context_of(after, "other").collect()} == {1} and after.columns == contexts.columns


def test_no_operations(spark):
    contexts = schemas.empty(spark, "working_context")
    results, after = C.change_contexts(contexts, spark.createDataFrame([], OPS), F.current_timestamp())
    assert results.count() == 0 and after.count() == 0
