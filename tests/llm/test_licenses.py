import re
import textwrap

import pytest
from pyspark.sql import functions as F

from stratagrid.llm import licenses


def _scan(spark, texts, **more):
    table = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], "doc_id long, text string, digest string, license string")
    return {r["doc_id"]: r for r in licenses.scan(table, **more).collect()}


def test_every_licence_in_every_wrapping(spark):
    texts, want = [], []
    for name, text in licenses.LICENCES:
        blocks = re.sub(r"<year>,? <holder>", "2024, Some Body", text).split("\n\n")
        for width in (30, 47, 60, 72, 100, 10_000):
            texts.append("\n\n".join(textwrap.fill(b, width, break_long_words=False) for b in blocks))
            want.append(name)
        texts += ["# " + text.upper().replace("\n", "\r\n# "), text.replace("Copyright (c) <year>", "(c) 1999-2003").replace('"', "``")]
        want += [name, name]
    got = _scan(spark, texts)
    assert [got[k]["license"] for k in range(len(texts))] == want


def test_a_copyright_clause_is_no_statement(spark):
    clause = "copyright notice and this permission notice appear in all copies."
    whole = [t for n, t in licenses.LICENCES if n == "ISC"][0]
    wrapped = whole.replace("provided that the above " + clause, "provided that the above\n" + clause)
    without = whole.replace("provided that the above " + clause, "provided that the above")
    got = _scan(spark, [wrapped, without])
    assert got[0]["license"] == "ISC" and got[1]["license"] is None


@pytest.mark.parametrize("literal_rows", [500, 0])
def test_notices(spark, literal_rows):
    texts = ["Hello\n  RELEASED under the MIT license!\nbye", "the MIT License is nice", None, "", "x\nReleased under the MIT Licence\nLicensed under CC BY 4.0\nreleased under the MIT license."]
    texts += [texts[0], "Copyright 2020 Me\n" + licenses.NOTICES[0][1]]
    got = _scan(spark, texts, literal_rows=literal_rows)
    assert [got[k]["notices"] for k in range(7)] == ["MIT", "", "", "", "CC-BY-4.0,MIT", "MIT", "Apache-2.0"]
    assert [got[k]["n_notices"] for k in range(7)] == [1, 0, 0, 0, 2, 1, 1]
    assert got[2]["digest"] is None and got[0]["license"] is None and got[6]["license"] == "Apache-2.0"
    assert _scan(spark, texts, notices=[], licences=[], literal_rows=literal_rows)[0]["notices"] == ""


def test_one_pass_without_python(spark):
    plan = licenses.scan(spark.range(3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|MapIn|Pandas", plan) and plan.count("Join") == plan.count("BroadcastHashJoin") == 1
