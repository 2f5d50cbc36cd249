"""Endings one by one, and length limits over a made-up corpus."""

import random

import pytest

from terraquery.llm import truncation as T

HEAD = "From: Ada Quill <ada.quill@a.example>\nSubject: x\n\n"
MULTI = 'From: a@b.example\nContent-Type: multipart/mixed; boundary="=_p1"\n\n--=_p1\nContent-Type: text/plain\n\nHello.\n'
FOOT = "\n_______________________________________________\nThis list is kept by us, owner@b.example\n"

CASES = [
    (None, None), ("", None), ("  \n", None),
    ("From: a@b.example\nSubject: te", "cut"), ("From: a@b.example\nSubject: te" + FOOT, "cut"),
    (MULTI, "cut"), (MULTI + "--=_p1--\n", "whole"), (MULTI + "--=_p1--" + FOOT, "whole"), (MULTI + "--=_p1", "cut"),
    (HEAD + "All is well.\n\n[Message clipped]", "open"), (HEAD + "All is we (more)", "open"), (MULTI + "--=_p1--\n[Message clipped]", "whole"),
    ("From: a@b.example\nContent-Transfer-Encoding: base64\n\nSGVsbG8gd29y", "open"), ("From: a@b.example\nContent-Transfer-Encoding: base64\n\nSGVsbG8gd29ybGQuC", "cut"),
    ("From: a@b.example\nContent-Transfer-Encoding: quoted-printable\n\nGr=C3=BC=C3", "open"), ("From: a@b.example\nContent-Transfer-Encoding: quoted-printable\n\nGr=C3=BC=", "cut"),
    (HEAD + "All is well.", "open"),
]


@pytest.mark.parametrize("text,proof", CASES)
def test_proof(text, proof):
    got = T.ending(text)
    assert (got and got[3]) == proof


@pytest.mark.parametrize("body,well", [
    ("All is well.", True), ("All is we", False), ("All is well. ", False), ("a total of 12.", False), ("> quoted\n>", True), ("是否可以？", True), ("我们打算", False),
    ("æ\x88\x91ä»¬ã\x80\x82", True), ("see (there)", True)])
def test_ends_well(body, well):
    assert T.ending(HEAD + body)[6] is well


def test_core_length_leaves_out_what_was_added():
    assert T.ending("x" * 90 + " [...]")[0] == 90 and T.ending(HEAD + "y" * 40 + FOOT)[0] == len(HEAD) + 40


def corpus(n=900, limit=700, seed=5):
    """Texts of one source cut at a limit, of another never; (id, text, source, cut).

    A text that ends with a whole closed line is within nothing and counts as complete.
    """
    rng = random.Random(seed)
    words = ["pump", "valve", "grid", "sensor", "archive", "reading", "schedule", "header", "pressure", "number"]
    out = []
    for i in range(n):
        body = ""
        for _ in range(rng.randint(3, 30)):
            body += " ".join(rng.choice(words) for _ in range(rng.randint(4, 9))).capitalize() + rng.choice([". ", ".\n\n"])
        text = HEAD + body.strip() + rng.choice(["\n\nCheers,\nAda Quill\n", "\n\nno rush\n", "\n"])
        cut = i % 2 == 0 and len(text) > limit
        out.append((i, text[:limit] if cut else text, [" Lim ", "free"][i % 2], cut and text[limit - 1] != "\n"))
    return out


def test_limits_and_flags(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, s, "clash") for i, t, s, _ in rows] + [(10_000, None, None, "x"), (10_001, "", "lim", "x")], "doc_id long, text string, source string, core_chars string")
    ends = T.endings(docs).cache()
    lengths = T.cut_lengths(ends)
    assert {(r["source"], r["length"]) for r in lengths.collect()} == {("lim", 700)}
    flagged = {r["doc_id"] for r in T.flag_truncated(ends, lengths).where("truncated").collect()}
    assert flagged == {i for i, _, _, cut in rows if cut}
    rates = {r["source"]: r for r in T.truncation_rates(docs, T.flag_truncated(ends, lengths)).collect()}
    assert rates["lim"]["cut"] == len(flagged) and rates["free"]["cut"] == 0 and rates[""]["texts"] == 1 and rates["lim"]["texts"] == 451


@pytest.mark.parametrize("remark", ["\n\n[fin du transfert]", " (suite 12)", "…", "..."])
def test_remarks_are_learnt_from_lengths(spark, remark):
    """Whatever a program adds at its limit also tells the texts that it cut elsewhere; a writer's own does not."""
    rows = [(i, t + (remark if cut else ""), s, cut) for i, t, s, cut in corpus()]
    broken = [(2000 + i, f"{HEAD}A word on number {'very ' * i}early, and the\nrest is no{remark}", "free", True) for i in range(3)]
    own = [(3000 + i, f"{HEAD}I will call {'very ' * i}soon.\n\nok for me (as ever)\n", "free", False) for i in range(30)]
    docs = spark.createDataFrame(rows + broken + own, "doc_id long, text string, source string, cut boolean")
    ends = T.endings(docs).cache()
    flagged = {r["doc_id"]: r["why"] for r in T.flag_truncated(ends, T.cut_lengths(ends)).where("truncated").collect()}
    assert set(flagged) == {i for i, _, _, cut in rows + broken + own if cut}
    assert {why for i, why in flagged.items() if i < 2000} == {"limit"} and {flagged[r[0]] for r in broken} == {"mark"}


def test_long_footer_and_long_remark():
    foot = "\n" + "-" * 40 + "\n" + "This list is kept by us. " * 80 + "\nowner@b.example\n"
    assert T.ending(HEAD + "y" * 40 + foot)[0] == len(HEAD) + 40
    assert T.ending(HEAD + "y" * 40 + " [" + "cut " * 300 + "]" + foot)[0] == len(HEAD) + 40
    assert T.ending(HEAD + "y" * 40 + "\n" + "-" * 40 + "\na\nb\nc\nd")[0] > len(HEAD) + 80


def test_complete_text_of_a_limits_length(spark):
    rows = corpus()
    end = "\n\nCheers,\nAda Quill\n"
    rows.append((5000, HEAD + ("All is well. " * 60)[: 700 - len(HEAD) - len(end)] + end, "lim", False))
    assert len(rows[-1][1]) == 700
    ends = T.endings(spark.createDataFrame(rows, "doc_id long, text string, source string, cut boolean")).cache()
    flagged = {r["doc_id"] for r in T.flag_truncated(ends, T.cut_lengths(ends)).where("truncated").collect()}
    assert flagged == {i for i, _, _, cut in rows if cut}


def test_copies_make_no_limit(spark):
    docs = spark.createDataFrame([(i, HEAD + "w" * 400 + ".\n", "a") for i in range(60)] + [(100 + i, HEAD + "w" * (300 + 7 * i) + ".\n", "a") for i in range(60)], "doc_id long, text string, source string")
    assert T.cut_lengths(T.endings(docs)).count() == 0


@pytest.mark.parametrize("label", ["", "Note: "])
def test_long_last_line_cut_inside(spark, label):
    line = (label + "this message is meant for its readers and no one else " * 8)[:399] + "."
    rows = [(i, f"{HEAD}The report is {'long ' * i}done.\n\n{line}\n") for i in range(6)] + [(6, f"{HEAD}Report of the pump.\n\n{line[:300]}"), (7, f"{HEAD}Report of the valve.\n\n{line[:260]}\n")]
    ends = T.endings(spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in T.flag_truncated(ends, T.cut_lengths(ends)).where("truncated").collect()} == {6, 7}


@pytest.mark.parametrize("end", ["and then the pump wi", "Pump: 12 Valves wi", "Note: Ada goes wi"])
def test_copies_of_a_cut_text_make_no_known_line(spark, end):
    text = "Here is the report.\n\n" + "\u00fcber den Stand. " * 20 + "\n" + end + "\n"
    copies = [(i, f"Message-ID: <{'x' * i}{i}@b.example>\n{HEAD}{text if i % 2 else text.encode().decode('latin-1')}") for i in range(4)]
    others = [(10 + i, f"{HEAD}{'A long line. ' * (i + 1)}\n\nyours in haste as ever, from the works of Ada\n") for i in range(8)]
    ends = T.endings(spark.createDataFrame([(*r, "a") for r in copies + others], "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in T.flag_truncated(ends, T.cut_lengths(ends)).where("truncated").collect()} == {0, 1, 2, 3}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    ends = T.endings(docs)
    assert T.flag_truncated(ends, T.cut_lengths(ends)).count() == 0
