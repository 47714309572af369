"""The filter audit against brute force over all orders, with files that bring smaller ids later."""

import itertools
import random

import pytest

from casewright.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, lang string, key string, n long"


def write(spark, path, parts):
    for rows in parts:
        spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    out = {}
    for d, text, lang in rows:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and d > least[text],
        }
        for o in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for i, f in enumerate(o):
                e = out.setdefault((lang or "", o, i + 1), dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0))
                here = fails[f] and not gone
                e["removed"] += here
                e["redundant"] += fails[f] and gone
                e["unique_fails"] += fails[f] and sum(fails.values()) == 1
                e["good_lost"] += here and d in good
                e["toxic_lost"] += here and d in toxic
                gone = gone or here
                e["kept"] += not gone
    for (part, o, step), e in out.items():
        e["shapley"] = sum(x["removed"] for (p, q, s), x in out.items() if p == part and q[s - 1] == o[step - 1]) if step == 1 or "shapley" not in e else e["shapley"]
    return out


def told(df):
    return {(r.part, r.filter_order, r.step): {k: r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} for r in df.collect()}


@pytest.mark.parametrize("combined", [50_000, 2])
def test_retractions_equal_brute_force(spark, tmp_path, monkeypatch, combined):
    monkeypatch.setattr(fa, "COMBINED", combined)
    rnd = random.Random(combined)
    texts = ["", None, "A B", "x # y", " ".join(f"w{i}" for i in range(250)), "dup " * 300, "a b\x1cc", " ".join(f"W{i}" for i in range(300))]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for _ in range(60)]
    rows += [(500, texts[5], "en")] * 3 + [(7, texts[5], "de")] * 2
    rows.sort(key=lambda r: -(r[0] or 0))  # files come with ever smaller ids
    write(spark, str(tmp_path / "docs"), [rows[i::5] if combined == 2 else rows[i * 13 : i * 13 + 13] for i in range(5)])
    labels = [(d, d % 2, (d // 2) % 2) for d in range(0, 30)] + [(4, 1, None), (None, 1, 1), (500, None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    expected = brute(rows[:65], labels)
    assert told(fa.filter_audit(spark, str(tmp_path / "docs"), table)) == expected


def test_labels_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fa, "BROADCAST_ROWS", 0)
    rows = [(i % 7, f"text {i % 3}", "en") for i in range(40)] + [(None, "text 1", None)]
    write(spark, str(tmp_path / "docs"), [rows[20:], rows[:20]])
    labels = [(d, 1, d % 2) for d in range(5)]
    got = fa.filter_audit(spark, str(tmp_path / "docs"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert told(got) == brute(rows, labels)


def test_micro_batches_and_the_empty_table(spark, tmp_path):
    write(spark, str(tmp_path / "docs"), [[(i, "same", "en")] for i in (9, 8, 7, 6, 5, 4)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = fa.mask_counts(fa.document_stream(spark, str(tmp_path / "docs")), labels)
    assert {(r.mask, r.n) for r in counts.collect() if r.n} == {(1, 1), (17, 5)}
    write(spark, str(tmp_path / "none"), [[]])
    assert fa.filter_audit(spark, str(tmp_path / "none"), labels).collect() == []


def test_shares_of_the_state_follow_the_root_of_the_table(spark, tmp_path, monkeypatch):
    folders = []
    monkeypatch.setattr(fa, "shared_dir", lambda spark: folders.append(str(tmp_path / "shared")) or folders[-1])
    rows = [(i, f"text {i % 700}", "en") for i in range(1500)]
    write(spark, str(tmp_path / "docs"), [rows[::2], rows[1::2]])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = told(fa.filter_audit(spark, str(tmp_path / "docs"), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, [])
    shares = [p.name for p in (tmp_path / "shared" / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(shares) == 3
    assert [fa.state_shares(n) for n in (0, 1, 100, 10_000, 1 << 40)] == [1, 1, 6, 51, fa.SHARES]
