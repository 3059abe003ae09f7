"""Model runs that go on where they stopped."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lorekeep.backends import HttpChat, _answered, chat_column
from lorekeep.plans import evaluate

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


class Model:
    """Writes down what it is asked; fails on prompts that hold ``bad``, and ends its process on ``kill``."""

    def __init__(self, log, bad="", kill="", warm=False):
        self.log, self.bad, self.kill = str(log), bad, kill
        if warm:
            self.warm_up = lambda: self._write("WARM")

    def _write(self, text):
        with open(self.log, "a") as f:
            f.write(text + "\n")

    def ask(self, prompt):
        if self.kill and self.kill in prompt:
            os._exit(3)
        self._write(prompt)
        if self.bad and self.bad in prompt:
            raise OSError("server is down")
        return f"<think>t</think> answer to {prompt}", len(prompt)

    def asked(self):
        with open(self.log) as f:
            return sorted(f.read().splitlines())


class Batch(Model):
    def batch(self, prompts):
        self._write(f"{len(prompts)} at once")
        if any("bad" in p for p in prompts):
            raise OSError("refused")
        return [(p.upper(), None) for p in prompts]


def _prompts(spark, prompts):
    rows = [(n, f"q{n}", p, ["s"]) for n, p in enumerate(prompts)]
    return spark.createDataFrame(rows, "query_id long, query string, prompt string, sources array<string>")


def test_failed_answers_are_asked_again_and_no_others(spark, tmp_path):
    prompts = _prompts(spark, ["one", "two", "two", "three", None])
    folder = str(tmp_path / "answers")
    first = Model(tmp_path / "first", bad="t")
    got = {r["id"]: r for r in evaluate.run_models(prompts, {"m": first}, folder, wave=2).collect()}
    assert first.asked() == ["", "one", "three", "two"]  # equal prompts once
    assert [got[n]["answer"] for n in (0, 4)] == ["answer to one", "answer to"] and got[0]["tokens"] == 3 and got[4]["tokens"] == 0
    assert all(got[n]["answer_raw"] == "[ERREUR: server is down]" and got[n]["tokens"] is None for n in (1, 2, 3))
    second = Model(tmp_path / "second")
    got = {r["id"]: r for r in evaluate.run_models(prompts, {"m": second}, folder).collect()}
    assert second.asked() == ["three", "two"]
    assert [got[n]["answer"] for n in range(4)] == ["answer to one", "answer to two", "answer to two", "answer to three"]
    other = Model(tmp_path / "other")
    assert evaluate.run_models(prompts, {"m": second, "other": other}, folder).count() == 10
    assert len(second.asked()) == 2 and len(other.asked()) == 4


def test_a_killed_run_keeps_its_finished_waves(spark, tmp_path):
    names = [f"prompt {n}" for n in range(12)]
    prompts, folder = _prompts(spark, names), str(tmp_path / "answers")
    kill = Model(tmp_path / "first", kill=names[5])
    with pytest.raises(Exception, match="."):
        evaluate.ask_missing(prompts, "m", kill, folder, wave=2)
    kept = {r["_answer"]["raw"].split("answer to ")[1] for r in evaluate.best_answers(spark, folder).collect()}
    again = Model(tmp_path / "second")
    assert evaluate.ask_missing(prompts, "m", again, folder, wave=2) == 12 - len(kept)
    assert again.asked() == sorted(set(names) - kept)
    assert evaluate.best_answers(spark, folder).where("NOT _answer.failed").count() == 12
    assert evaluate.ask_missing(prompts, "m", again, folder) == 0


def test_no_prompts(spark, tmp_path):
    model = Model(tmp_path / "log")
    assert evaluate.run_models(_prompts(spark, ["a"]).where("query_id > 0"), {"m": model}, str(tmp_path / "answers")).count() == 0


def test_warm_up_comes_first_and_batches_fall_back(spark, tmp_path):
    warm = Model(tmp_path / "warm", warm=True)
    told = _prompts(spark, ["a", "b"]).coalesce(1).select(chat_column(warm)(F.col("prompt")).alias("x")).select("x.*").collect()
    assert [r["tokens"] for r in told] == [1, 1] and not any(r["failed"] for r in told)
    with open(warm.log) as f:
        assert f.readline() == "WARM\n"
    batch = Batch(tmp_path / "batch", bad="bad")
    assert [r[0] for r in _answered(batch, ["x", "y"])] == ["X", "Y"]
    mixed = _answered(batch, ["x", "bad"])
    assert [r[3] for r in mixed] == [False, True] and mixed[0][2] == 1
    assert batch.asked() == ["2 at once", "2 at once", "bad", "x"]


def test_tokens_of_a_server(monkeypatch):
    reply = {"choices": [{"message": {"content": "hi"}}], "usage": {"completion_tokens": 7}}
    seen = []
    monkeypatch.setattr(HttpChat, "complete", lambda self, content, timeout=None, **o: seen.append((content, timeout)) or reply)
    chat = HttpChat("http://x", "m")
    assert chat.ask("p") == ("hi", 7) and chat("p") == "hi"
    chat.warm_up()
    assert seen[-1][1] == 300
