import json
import random
import time

from casewright.operators import replies
from casewright.streaming import closing, events
from test_sources import EXPECTED, FEED

LINES = "request_id string, seq long, line string"


def said(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def drained(spark, path, schema, stream, state, rows=()):
    """Adds rows to a folder, runs the stream over what is new, and gives its rows and the rows of its state."""
    path.mkdir(exist_ok=True)
    if rows:
        (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    with closing.state_on_disk(spark):
        source = spark.readStream.schema(schema).json(str(path))
        query = events.run_available(stream(source), lambda batch, _: seen.extend(batch.collect()), state, "append")
    return seen, query.lastProgress.stateOperators[0].numRowsTotal


def test_jobs_close_and_their_state_ends(spark, tmp_path):
    rnd = random.Random(4)
    feed = [*FEED, {"job_id": "two", "seq": 3, "type": "end"}, {"job_id": "late", "seq": 4, "type": "end"}]
    halves = [[r for r in feed if r["job_id"] in ("two", "bare")], [r for r in feed if r["job_id"] not in ("two", "bare")]]
    seen, state = [], str(tmp_path / "state")
    fold = lambda s: closing.fold_stream(s, idle_ms=3_600_000)
    for half in halves:
        rnd.shuffle(half)
        got, n = drained(spark, tmp_path / "feed", events.EVENTS, fold, state, half)
        seen += got
    assert {r.job_id: (r.status, r.message, r.result and json.loads(r.result)["template"]) for r in seen} == {k: v for k, v in EXPECTED.items() if k != "none"} and len(seen) == 3
    assert n > 0
    after, n = drained(spark, tmp_path / "feed", events.EVENTS, fold, state, [{"job_id": "two", "seq": 9, "type": "error", "message": "too late"}])
    assert after == []


def test_timers_close_what_is_left(spark, tmp_path):
    fold, state = (lambda s: closing.fold_stream(s, idle_ms=1)), str(tmp_path / "state")
    rows = [{"job_id": "none", "seq": 1, "type": "progress"}, {"job_id": "some", "seq": 1, "type": "result", "template": "x"}]
    seen, n = drained(spark, tmp_path / "feed", events.EVENTS, fold, state, rows)
    time.sleep(2)
    got, n = drained(spark, tmp_path / "feed", events.EVENTS, fold, state, [{"job_id": "other", "seq": 1, "type": "end"}])
    told = {r.job_id: (r.status, r.message) for r in seen + got}
    assert told == {"none": ("incomplete", events.INCOMPLETE), "some": ("done", None), "other": ("incomplete", events.INCOMPLETE)} and len(seen + got) == 3
    assert n <= 2  # what is closed but not yet forgotten, and its timer


def test_replies_in_any_order_equal_the_batch(spark, tmp_path):
    rnd = random.Random(8)
    rows = []
    for i in range(25):
        n = rnd.randint(0, 8)
        lines = [rnd.choice([said(f"t{j} "), said("é"), ": comment", "data: {bad", 'data: {"choices":[]}']) for j in range(n)] + ["data: [DONE]", said("late"), "data: [DONE]"]
        rows += [{"request_id": f"r{i}", "seq": j, "line": x} for j, x in enumerate(lines)]
    expected = {r.request_id: r.content for r in replies.assembled(spark.createDataFrame([tuple(r.values()) for r in rows], LINES)).collect()}
    rnd.shuffle(rows)
    seen = []
    for i in range(3):
        got, n = drained(spark, tmp_path / "lines", LINES, closing.assembled_stream, str(tmp_path / "state"), rows[i::3])
        seen += got
    assert {r.request_id: r.content for r in seen} == expected and len(seen) == len(expected) == 25


def test_replies_without_an_end(spark, tmp_path):
    stream, state = (lambda s: closing.assembled_stream(s, idle_ms=1)), str(tmp_path / "state")
    rows = [{"request_id": "a", "seq": s, "line": said(str(s))} for s in (4, 0, 2)]
    seen, n = drained(spark, tmp_path / "lines", LINES, stream, state, rows)
    time.sleep(2)
    got, n = drained(spark, tmp_path / "lines", LINES, stream, state, [{"request_id": "b", "seq": 0, "line": "data: [DONE]"}])
    assert sorted((r.request_id, r.content) for r in seen + got) == [("a", "024"), ("b", "")]
