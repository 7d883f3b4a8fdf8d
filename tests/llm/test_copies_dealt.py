"""Exact dedup of rows: no join where all copies of a text meet."""

import re
from collections import Counter

from harborline.llm import exact_dedup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_text_meet_in_no_join(spark, monkeypatch):
    rows = [(i, "one text") for i in range(400)] + [(i, f"own {i}") for i in range(400, 500)]
    rows += [(399, "one text"), (399, "one text"), (None, "one text"), (7, "own 400"), (7, "own 7"), (450, "own 450")]
    rows += [(None, "no id"), (None, "no id"), (None, ""), (501, None), (502, ""), (None, None), (503, "é"), (503, "é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    plans, plain = [], exact_dedup.spool
    monkeypatch.setattr(exact_dedup, "spool", lambda table, label: plans.append(plan(table)) or plain(table, label))
    for keep, pick in (("largest", max), ("smallest", min)):
        plans.clear()
        out = exact_dedup.drop_copies(df, keep=keep)
        plans.append(plan(out))
        assert re.findall(r"(\w+Join) \[(\w+)#", "\n".join(plans)) == [("SortMergeJoin", "place")]
        ids = {}
        for i, t in rows:
            ids.setdefault(t or "", []).append(i)
        want = {t: pick((i for i in held if i is not None), default=None) for t, held in ids.items()}
        assert Counter((r.text or "", r.doc_id) for r in out.collect()) == Counter(want.items())
