"""Pages of positioned words: bands between tables, lines, and the cases at their borders."""

import random

from casewright.sources import pages, words
import model

WORD = "doc_id long, page int, x0 double, top double, x1 double, bottom double, word_no long, text string"
TABLE = "doc_id long, page int, x0 double, top double, x1 double, bottom double, table_no long, cells array<array<string>>"
SIZE = "doc_id long, page int, width double, height double"


def texts(spark, said, boxes, sizes):
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((said, WORD), (boxes, TABLE), (sizes, SIZE))]
    return {(r.doc_id, r.page): r.page_text for r in pages.page_texts(words.word_blocks(*frames)).collect()}


def test_random_pages_equal_the_model(spark):
    rng, said, boxes, sizes, expected = random.Random(11), [], [], [], {}
    for doc in range(60):
        for page in range(3):
            size = (100.0, 120.0) if rng.random() < 0.8 else None
            put = lambda: (x := rng.randint(-8, 104), y := rng.randint(-6, 124), x + rng.randint(1, 9), y + rng.choice((1, 2, 4, 9, 40)))
            w = [(*map(float, put()), rng.choice(("a", "bb ", " c", "", "dd"))) for _ in range(rng.randint(0, 25))]
            t = []
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                x0, y0, x1, _ = put()
                rows = [["r%d" % rng.randint(0, 9), rng.choice((None, " x\ny "))] for _ in range(rng.randint(0, 2))]
                t.append((float(x0), y0 + rng.choice((0.0, 0.004, 0.3)), float(x1), y0 + rng.choice((0.31, 1.0, 6.0, 30.0)), rows))
            said += [(doc, page, *b[:4], n, b[4]) for n, b in enumerate(w)]
            boxes += [(doc, page, *b[:4], n, b[4]) for n, b in enumerate(t)]
            sizes += [(doc, page, *size)] if size else []
            if text := model.page_of_words(w, t, size):
                expected[doc, page] = text
    assert texts(spark, said, boxes, sizes) == expected


def test_words_beside_a_table_are_left_out_and_bands_are_read_in_order(spark):
    box = [(1, 0, 10.0, 20.0, 60.0, 40.0, 0, [["id", "what"], ["1", "open"]])]
    said = [(1, 0, 10.0, 5.0, 20.0, 9.0, 2, "Before"), (1, 0, 22.0, 7.0, 30.0, 11.0, 1, "it"), (1, 0, 70.0, 28.0, 80.0, 32.0, 3, "beside"), (1, 0, 10.0, 50.0, 20.0, 54.0, 0, "after")]
    assert texts(spark, said, box, [(1, 0, 100.0, 100.0)]) == {(1, 0): "Before it\nid | what\n1 | open\n\nafter"}


def test_a_word_over_a_thin_table_stands_in_both_bands(spark):
    box = [(1, 0, 0.0, 20.0, 60.0, 22.0, 0, [["c"]])]
    assert texts(spark, [(1, 0, 1.0, 18.0, 5.0, 25.0, 0, "w")], box, [(1, 0, 100.0, 100.0)]) == {(1, 0): "w\nc\n\nw"}


def test_nulls_blanks_and_pages_without_room(spark):
    said = [(1, 0, None, 1.0, 2.0, 2.0, 0, "no box"), (1, 0, 1.0, 5.0, 2.0, 6.0, 1, None), (1, 1, 1.0, 5.0, 2.0, 6.0, 1, "hidden"), (None, 0, 1.0, 1.0, 2.0, 2.0, 0, "lost")]
    said += [(2, 0, 1.0, 1.0, 2.0, 2.0, 0, "same"), (2, 0, 1.0, 1.0, 2.0, 2.0, 0, "same")]
    box = [(1, 1, 0.0, 0.0, 100.0, 100.0, 0, [["all"]]), (1, 2, 0.0, 0.0, 1.0, 1.0, 0, None)]
    got = texts(spark, said, box, [(1, 1, 100.0, 100.0)])
    assert got == {(1, 1): "all\n", (2, 0): "same same", (None, 0): "lost"}


def test_empty_tables_give_no_pages(spark):
    assert texts(spark, [], [], []) == {}


def test_pages_are_dealt_to_as_many_tasks_as_are_asked_for(spark):
    said = [(d, 0, 1.0, 5.0, 2.0, 6.0, n, f"w{n}") for d in range(20) for n in range(3)]
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((said, WORD), ([], TABLE), ([], SIZE))]
    blocks = words.word_blocks(*frames, tasks=9)
    assert ", 9)" in blocks._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.page_text) for r in pages.page_texts(blocks).collect()} == {(d, "w0 w1 w2") for d in range(20)}
