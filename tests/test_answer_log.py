"""Answers of a model: threads in a task, and a log that asks nothing twice."""

import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extract


def counting(folder):
    """Makes clients that leave a file for each call; prompts with ``bad`` fail, and one
    with ``fatal`` ends the task while the folder has a file of that name."""

    class Client:
        def complete_json(self, system, user):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(user)
            if "bad" in user:
                raise RuntimeError("no")
            if "fatal" in user and os.path.exists(f"{folder}/fatal"):
                os._exit(1)
            time.sleep(0.05)
            return json.dumps({"said": user.upper()})

    return Client


def calls(folder):
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder) if n != "fatal")


def ask(log, rows, folder, **options):
    return {r.id: r for r in extract.complete(rows, "id", "system", "user", counting(folder), retries=1, pause=0, log=log, **options).collect()}


def test_threads_keep_each_rows_answer(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"q{k}" if k % 5 else " ") for k in range(40)], "id long, user string").coalesce(1)
    began = time.time()
    got = ask(None, rows, str(tmp_path), threads=8)
    assert time.time() - began < 30 and len(calls(tmp_path)) == 32
    assert all((r.raw is None and r.error is None) if k % 5 == 0 else json.loads(r.raw) == {"said": f"Q{k}"} for k, r in got.items()) and len(got) == 40


def test_nothing_is_asked_twice(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    log = extract.AnswerLog(spark, f"file://{tmp_path}/log", steps=3)
    prompts = [(k, f"q{k % 10}") for k in range(20)] + [(20, "bad"), (21, None), (22, "  ")]
    rows = spark.createDataFrame(prompts, "id long, user string").repartition(3)
    got = ask(log, rows, str(folder))
    assert calls(folder) == sorted([f"q{k}" for k in range(10)] + ["bad"] * 2)
    assert len(got) == 23 and all(json.loads(got[k].raw)["said"] == f"Q{k % 10}" and got[k].error is None for k in range(20))
    assert got[20].error == "RuntimeError: no" and got[21].raw is None and got[22].error is None
    # Again, with one more: only that one, and what failed.
    more = rows.unionByName(spark.createDataFrame([(30, "new"), (None, "q1")], "id long, user string"))
    got = ask(extract.AnswerLog(spark, f"file://{tmp_path}/log"), more, str(folder))
    assert calls(folder) == sorted([f"q{k}" for k in range(10)] + ["bad"] * 4 + ["new"]) and got[30].raw and got[None].raw
    # Another system prompt is another question.
    other = extract.complete(rows.where("id = 3"), "id", "other", "user", counting(str(folder)), log=log).collect()
    assert len(other) == 1 and calls(folder).count("q3") == 2


def test_a_run_that_breaks_off_has_kept_its_steps(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    (folder / "fatal").touch()
    log = extract.AnswerLog(spark, f"file://{tmp_path}/log", steps=4)
    rows = spark.createDataFrame([(k, f"q{k}") for k in range(24)] + [(99, "fatal")], "id long, user string").coalesce(1)
    with pytest.raises(Exception):
        ask(log, rows, str(folder))
    kept = log.read("answers").count()
    (folder / "fatal").unlink()
    before = len(calls(folder))
    got = ask(log, rows, str(folder))
    assert len(got) == 25 and all(r.raw for r in got.values()) and len(calls(folder)) - before == 25 - kept
    assert log.read("answers").select(F.count_distinct("key")).first()[0] == 25
