"""Line rules of four languages, and the query's SQL on hand-made texts."""

import duckdb
import pytest

from corvane.llm import quality_rules

from .test_llm import docs

MORE = "Another sentence follows here, with words of its own, and it is kept too."
GOOD = "This is a plain line of text that is long enough and ends well."


@pytest.mark.parametrize(
    "line",
    ["Accueil | Plan du site", "Mentions légales tous droits réservés", "MENTIONS LÉGALES ET AUTRES TEXTES QUI SONT très longs ici encore.", "Impressum Datenschutz", "Startseite.", "Nächste Seite.", "NÄCHSTE Seite: drei vier.", "Alle Rechte vorbehalten.", "Inicio.", "Leer más.", "Aviso legal: siete palabras en esta línea de aquí.", "a short line", "Menü!", "next page.", "- Home", "* Mehr lesen", "2) Search", "-dash", "Follow us on Facebook and on many other networks of ours.", "Copyright 2021 Example Ltd and all of its partners."],
)
def test_lines_that_go(line):
    *_, lost, kept, left = quality_rules.judge(f"{GOOD}\n{line}\n{MORE}".encode(), quality_rules.Limits())
    assert lost == len(line.split()) and kept and line not in left.decode()


@pytest.mark.parametrize("line", ["Homeland is a word that begins otherwise.", "Menüs sind etwas anderes.", "Inicios de otra cosa.", "„So endet es auch”", "Ein Satz…", "Fin »", "a line of text without a mark may be long and stays", "終わり。", "x.\t \x0b", "(so)", "- an item of a list", "  12) another item", "* a longer item here", "\tindented code", "    return a", "x = f(y", "• ein Punkt"])
def test_lines_that_stay(line):
    *_, lost, _, left = quality_rules.judge(f"{GOOD}\n{line}".encode(), quality_rules.Limits())
    assert lost == 0 and line in left.decode()


def test_own_words():
    limits = quality_rules.Limits(boilerplate=(), menu=("etusivu",))
    *_, lost, _, _ = quality_rules.judge(f"{GOOD}\nEtusivu ja muut.\nAll rights reserved.".encode(), limits)
    assert lost == 3


def test_sql_agrees_on_odd_lines(spark):
    lines = [GOOD, "Accueil.", "ACCUEIL.", "MENTIONS LÉGALES ET le reste de cette ligne est assez long.", "Menü", "MENÜ!", "Menüs da.", "x\x85", "\x85.", " home .", "\thome\x0b", "q »", "HAGA CLIC AQUÍ.", "Página siguiente.", "PÁGINA siguiente dos!", "a .", "z？", "end ", "ok: ", "]", "conditions d'utilisation du service et de toutes ses autres parties", "- item", "-item", "3. Home", "3.  ok", "•\tx", "• ", "    code", "a = b", "a =b", "Copyright © me"]
    rows = [(i, f"{GOOD} {i}\n{a}\n{b}") for i, (a, b) in enumerate((x, y) for x in lines for y in lines[::3])] + [(900, None), (901, ""), (902, "long " * 20_000 + "\n" + "w" * 100_000)]
    frame = docs(spark, rows)
    c = duckdb.connect()
    c.register("documents", frame.toPandas())
    found = c.sql(quality_rules.ORACLE_SQL)
    want = sorted(dict(zip(found.columns, r, strict=True)).items() for r in found.fetchall())
    got = quality_rules.quality_rules(frame)
    assert sorted(sorted(r.asDict().items()) for r in got.collect()) == sorted(sorted(x) for x in want)


def test_lists_and_code_do_not_reject_a_document():
    text = "- first item\n- second item here\n3) third item of it\ndef f(x):\n    return x\ny = f(2)\nThis is one sentence of plain prose that ends well."
    *_, lost, kept, left = quality_rules.judge(text.encode(), quality_rules.Limits())
    assert kept and lost == 0 and left.decode() == text
