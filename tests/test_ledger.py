import json
import os

import pytest

from casewright.operators import ledger, replies
from casewright.plans.batch import Options, run_folder
from casewright.sources.commits import committed
from test_batch import plan


def counted(folder, fail):
    """A function of a payload that leaves a file for each time it is asked, and what it was asked."""
    os.makedirs(folder, exist_ok=True)

    def ask(payload):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(payload)
        error = fail(payload, sum(open(f"{folder}/{x}").read() == payload for x in os.listdir(folder)))
        if error:
            raise error
        return payload.upper()

    return ask


def asked(folder):
    told = [open(f"{folder}/{x}").read() for x in os.listdir(folder)]
    return {p: told.count(p) for p in told}


def requests(spark, payloads):
    return spark.createDataFrame([(i, i % 3, p) for i, p in enumerate(payloads)], "doc_id long, section_no int, payload string")


def test_rounds_repeat_what_is_worth_it_and_nothing_else(spark, tmp_path):
    def fail(p, nth):
        if p.startswith("busy") and nth < 3 or p.startswith("never"):
            return OSError("HTTP error 503")
        return ValueError("HTTP error 400") if p.startswith("bad") else None

    payloads = [*(f"good {i}" for i in range(60)), "busy 1", "busy 2", "bad", "never", "good 1", "", None]
    calls = requests(spark, payloads)
    got = ledger.call_once(calls, ledger.each(counted(str(tmp_path / "n"), fail)), str(tmp_path / "calls"), piece=7).collect()
    n = asked(tmp_path / "n")
    assert n == {p: 3 if p.startswith("busy") else 6 if p == "never" else 1 for p in payloads if p is not None}
    assert len(got) == len(payloads) and {r.doc_id for r in got} == set(range(len(payloads)))
    for r in got:
        p = payloads[r.doc_id] or ""
        assert (r.content, r.error, r.attempt) == ((None, "HTTP error 400", 1) if p == "bad" else (None, "HTTP error 503", 6) if p == "never" else (p.upper(), None, 3 if p.startswith("busy") else 1))
    # the next run keeps good answers and asks what failed anew
    again = ledger.call_once(calls, ledger.each(counted(str(tmp_path / "m"), lambda p, nth: None)), str(tmp_path / "calls"))
    assert again.where("error IS NULL").count() == len(payloads) and asked(tmp_path / "m") == {"bad": 1, "never": 1}
    assert ledger.call_once(calls.limit(0), ledger.each(str.upper), str(tmp_path / "none")).collect() == []


def test_a_lost_task_and_a_lost_run_repeat_no_answered_call(spark, tmp_path):
    ask = counted(str(tmp_path / "n"), lambda p, nth: None)

    def caller(payloads):  # the task ends in the middle of a piece
        for p in payloads:
            if p == "15":
                raise SystemExit("lost")
            yield ask(p)

    payloads = [str(i) for i in range(40)]
    with pytest.raises(Exception):
        ledger.call_once(requests(spark, payloads), caller, str(tmp_path / "calls"), tasks=1, piece=10)
    before = asked(tmp_path / "n")
    assert 0 <= len(before) < 40
    got = ledger.call_once(requests(spark, payloads), ledger.each(ask), str(tmp_path / "calls"), tasks=1, piece=10)
    assert sorted(r.content for r in got.collect()) == sorted(payloads)
    assert asked(tmp_path / "n") == {p: 1 for p in payloads}


def test_a_task_that_runs_again_reads_what_it_was_answered(spark, tmp_path):
    ask, todo = counted(str(tmp_path / "n"), lambda p, nth: None), spark.createDataFrame([(str(i), str(i)) for i in range(30)], "digest string, payload string").repartition(2, "digest")
    for _ in range(2):
        ledger._round(todo, ledger.each(ask), str(tmp_path / "pieces"), "r", 1, 4)
    assert len([x for _, _, fs in os.walk(tmp_path / "pieces") for x in fs if x.startswith("answers-")]) == 2  # a quick caller: a file a task
    assert asked(tmp_path / "n") == {str(i): 1 for i in range(30)}
    assert ledger.read(spark, str(tmp_path / "pieces")).count() == 30


def test_answers_of_a_slow_caller_are_written_as_they_come(spark, tmp_path):
    todo = spark.createDataFrame([(str(i), str(i)) for i in range(6)], "digest string, payload string").repartition(1)
    ledger._round(todo, ledger.each(str.upper), str(tmp_path / "pieces"), "r", 1, 32, seconds=0.0)
    assert len([x for _, _, fs in os.walk(tmp_path / "pieces") for x in fs if x.startswith("answers-")]) == 6
    assert ledger.read(spark, str(tmp_path / "pieces")).count() == 6


@pytest.mark.parametrize("raises_at", [0, 1, 3])
def test_answers_before_an_error_stand(raises_at):
    told = []

    def caller(payloads):
        for i, p in enumerate(payloads):
            told.append(p)
            if p == f"p{raises_at}":
                raise ValueError("no")
            yield p

    payloads = [f"p{i}" for i in range(5)]
    assert list(ledger.answers(caller, payloads)) == [(None, "no") if i == raises_at else (p, None) for i, p in enumerate(payloads)]
    assert all(told.count(p) == 1 for p in payloads if p != f"p{raises_at}")
    assert list(ledger.answers(lambda ps: ["x"] * 9, ["a", "b"])) == [("x", None)] * 2
    assert list(ledger.answers(lambda ps: ps[:1], ["a", "b"])) == [("a", None), (None, "as many replies as requests are expected")]
    assert list(ledger.answers(lambda ps: [], ["a"])) == [(None, "as many replies as requests are expected")]


def test_a_folder_run_takes_over_the_calls_of_a_lost_one(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    plan(source, "a.docx", "TC_1_A", "TC_2_B")
    seen = str(tmp_path / "n")
    os.makedirs(seen)

    def ask(payload):
        import uuid

        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write(payload)
        return json.dumps({"test_cases": [{"test_id": "T" + str(len(payload))}]})

    options = Options(caller=ledger.each(ask), model="m", level="2")
    with monkeypatch.context() as m:
        m.setattr(replies, "with_cases", lambda x: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            run_folder(spark, str(source), out, options)
    assert sorted(asked(seen).values()) == [1, 1]
    assert run_folder(spark, str(source), out, options).first().written == 1
    assert sorted(asked(seen).values()) == [1, 1] and not (tmp_path / "out" / "calls").exists()
    assert committed(spark, out, "cases").count() >= 1
    run_folder(spark, str(source), out, Options(caller=ledger.each(ask), model="m", level="2", force=True))
    assert sorted(asked(seen).values()) == [2, 2]  # forced: asked anew
