"""Line-first cleaning: rules on punctuation, navigation and boilerplate are applied to each line, failing lines are
removed, and a document that loses too much of its text is rejected.

Rules of a line that has a word (in words, symbols are `[#*$%&|<>]`, letters are A-Z and a-z):

* punctuation: over 30 symbols to 100 words, or over 20 words to 100 that hold `!!` or `??`, or eight words at most and no
  final mark, one of FINAL, at the end, where the line is no list item (a dash, star, dot or number before a space) and no code
  (four spaces or a tab before it, or ` = ` inside)
* shouting: three words or more, and more capital than small letters
* navigation: three or more of ` | `, ` > `, ` » ` separators, or eight words at most that begin with a menu word, as
  an item of a list too
* boilerplate: holds one of BOILERPLATE, or equals an earlier line of the document (of three words or more)

Menu words and boilerplate are those of English, French, German and Spanish pages; a corpus of other languages brings its own by
Limits. Capitals count as small letters, those of ÀÉ and the like as well. A line without words is kept and counts as nothing.

Results for edge cases: a null or empty text has no words, so its base fails and it is not kept. A text of any length is judged
whole, and a long line is one line. A null id stays null. Repeated rows give repeated result rows. An empty table gives an empty
result. Other columns are not read, whatever their names; clean_documents() passes them on, keeps or drops repeated rows alike,
and drops rows whose text is null or empty.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Rows, hash_words, id_and_text, map_arrow, rows_of, small_batches, trim, window_hashes, words_of

SYMBOLS = "#*$%&|<>"
# Phrases of boilerplate, and words that begin a menu line, of English, French, German and Spanish pages.
BOILERPLATE = (
    *("all rights reserved", "terms of use", "privacy policy", "cookie policy", "use cookies", "lorem ipsum", "enable javascript", "javascript is disabled", "follow us on", "copyright ©", "copyright 19", "copyright 20"),
    *("tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "activer javascript", "suivez-nous sur"),
    *("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "javascript aktivieren", "folgen sie uns"),
    *("todos los derechos reservados", "aviso legal", "política de privacidad", "términos de uso", "condiciones de uso", "utiliza cookies", "activar javascript", "síguenos en"),
)
MENU = (
    *("home", "login", "log in", "sign in", "sign up", "register", "search", "menu", "skip to", "click here", "read more", "share this", "next page", "previous page", "back to top"),
    *("accueil", "connexion", "se connecter", "plan du site", "lire la suite", "cliquez ici", "haut de page", "page suivante", "page précédente"),
    *("startseite", "anmelden", "impressum", "datenschutz", "menü", "weiterlesen", "mehr lesen", "hier klicken", "nach oben", "nächste seite", "vorherige seite", "zum inhalt"),
    *("inicio", "iniciar sesión", "leer más", "haga clic aquí", "volver arriba", "página siguiente", "página anterior", "ir al contenido"),
)
FINAL = (".", "!", "?", "…", ":", ";", '"', "'", "»", "”", "’", ")", "]", "}", "。", "！", "？")
SEPARATORS = (b" | ", b" > ", " » ".encode())
_CAPS, _SMALL = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_SHOUT = re.compile(rb"!!|\?\?")
#: A list item, or an indented line.
_ITEM = "(?:[-*+]|•|[0-9]{1,3}[.)])[ \\t]+"
_SPARED = re.compile(f"[ \\t]*{_ITEM}[^ \\t\\r]|(?: {{4}}|\\t)".encode())
_FINAL = tuple(x.encode() for x in FINAL)
_SPACES = b" \t\n\v\f\r"


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    #: Per cent of the words that may stand in repeated five-word windows.
    max_repeat: int = 20
    #: Per cent of the words that cleaning may remove.
    max_lost: int = 40
    boilerplate: tuple[str, ...] = BOILERPLATE
    menu: tuple[str, ...] = MENU

    @cached_property
    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """Of boilerplate anywhere, and of a menu word at the start that no letter follows; for lines with small letters a-z."""
        any_of = lambda words: "|".join("".join(f"(?:{c}|{c.upper()})" if c > "\x7f" else re.escape(c) for c in w) for w in words) or "(?!)"
        return re.compile(any_of(self.boilerplate).encode()), re.compile(f"(?:{_ITEM})?(?:{any_of(self.menu)})(?![a-z\x00])".encode().replace(b"\x00", b"\x80-\xff"))


def repeat_words(words: list[bytes], n: int = 5) -> int:
    """Words in n-word windows that are found twice or more."""
    if len(words) <= n:
        return 0
    h = window_hashes(hash_words(words), n)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _count(line: bytes, those: bytes) -> int:
    return len(line) - len(line.translate(None, those))


def line_fails(line: bytes, n_words: int, seen: bool, limits: Limits, phrases: bool = True) -> bool:
    """phrases: whether the line's text holds boilerplate anywhere."""
    if _count(line, SYMBOLS.encode()) * 100 > 30 * n_words or (b"!!" in line or b"??" in line) and 100 * sum(1 for w in line.split() if _SHOUT.search(w)) > 20 * n_words:
        return True
    if n_words <= 8 and not line.rstrip(_SPACES).endswith(_FINAL) and not _SPARED.match(line) and b" = " not in line:
        return True
    if n_words >= 3 and (seen or _count(line, _CAPS) > _count(line, _SMALL)):
        return True
    low = line.lower()
    boilerplate, menu = limits.patterns
    if sum(low.count(s) for s in SEPARATORS) >= 3 or n_words <= 8 and menu.match(low.lstrip(_SPACES)):
        return True
    return phrases and bool(boilerplate.search(low))


def judge(text: bytes | None, limits: Limits) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept and the text that is left."""
    text = text or b""
    words = words_of(text)
    n, chars = len(words), text.decode("utf-8", "replace")
    word_chars = len(chars) - sum(map(chars.count, " \t\n\v\f\r"))
    seen: set[bytes] = set()
    left, dup, lost, low = [], 0, 0, chars.lower()
    phrases = any(p in low for p in limits.boilerplate)  # one look for all lines
    for line in text.split(b"\n"):
        if not (k := len(line.split())):
            left.append(line)
            continue
        old = line in seen
        dup += old
        seen.add(line)
        if line_fails(line, k, old, limits, phrases):
            lost += k
        else:
            left.append(line)
    repeat = repeat_words(words)
    failed = n < limits.min_words or 100 * repeat > limits.max_repeat * n
    return n, word_chars, sum(map(chars.count, SYMBOLS)), dup, repeat, failed, lost, not failed and 100 * lost <= limits.max_lost * n, b"\n".join(left)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_words long, kept boolean"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), with_text: bool = False) -> DataFrame:
    """One row per row of docs; with_text adds clean_text, the text without its failing lines."""
    fields = [("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("lost_words", pa.int64()), ("kept", pa.bool_())]
    schema = pa.schema(fields + [("clean_text", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema, 2_000 if with_text else 20_000)
        for batch in batches:
            for i, text in rows_of(batch):
                *found, clean = judge(text, limits)
                out.add(i, *found, *[clean] * with_text)
                if out.full:
                    yield out.take()
        yield out.take()

    got = id_and_text(docs, id_col, text_col).transform(map_arrow, run, SCHEMA + ", clean_text binary" * with_text)
    return got.withColumn("clean_text", got["clean_text"].cast("string")) if with_text else got


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", limits: Limits = Limits()) -> DataFrame:
    """The columns of docs for the documents that are kept, with their failing lines taken out of the text; length_col, where docs have it, follows the text."""
    small_batches(docs.sparkSession)
    judged = docs.withColumn("__corvane_verdict", _verdict(limits)(F.col(text_col).cast("binary"))).filter("__corvane_verdict is not null")
    names = docs.columns
    length = {length_col: F.length("__corvane_verdict").cast(docs.schema[length_col].dataType)} if length_col in names else {}
    return judged.withColumns(length | {text_col: F.col("__corvane_verdict")}).select(*[F.col(f"`{n}`") for n in names])


def _verdict(limits: Limits):
    @F.arrow_udf(T.StringType())
    def clean(text: pa.Array) -> pa.Array:
        """The cleaned text of a document that is kept, else null."""
        found = (judge(t, limits) for t in text.to_pylist())
        out = pa.array([x[-1].decode("utf-8", "replace") if x[-2] else None for x in found], pa.string())
        trim()
        return out

    return clean.asNondeterministic()  # else the filter would run it once more


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, p, list_slice(ws, p, p + 4) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS p FROM w WHERE len(ws) > 4)),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(generate_series(1, len(string_split(t, chr(10))))) AS i FROM d),
ln AS (SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k FROM raw),
ln2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS seen, lower(line) AS low FROM ln WHERE k > 0),
bad AS (SELECT doc_id, k, seen,
    len(regexp_extract_all(line, '[#*$%&|<>]')) * 100 > 30 * k
    OR 100 * len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '!!|\?\?'))) > 20 * k
    OR (k >= 3 AND (seen OR len(regexp_extract_all(line, '[A-Z]')) > len(regexp_extract_all(line, '[a-z]'))))
    OR len(regexp_extract_all(low, ' \| ')) + len(regexp_extract_all(low, ' > ')) + len(regexp_extract_all(low, ' » ')) >= 3
    OR (k <= 8 AND NOT regexp_matches(line, '[.!?…:;"''»”’)\]}。！？][\x20\x09-\x0D]*$') AND NOT regexp_matches(line, '^(?:[ \t]*(?:[-*+]|•|[0-9]{1,3}[.)])[ \t]+[^ \t\r]|(?: {4}|\t))') AND NOT contains(line, ' = '))
    OR (k <= 8 AND regexp_matches(low, '^[\x20\x09-\x0D]*(?:(?:[-*+]|•|[0-9]{1,3}[.)])[ \t]+)?(?:home|login|log in|sign in|sign up|register|search|menu|skip to|click here|read more|share this|next page|previous page|back to top|accueil|connexion|se connecter|plan du site|lire la suite|cliquez ici|haut de page|page suivante|page précédente|startseite|anmelden|impressum|datenschutz|menü|weiterlesen|mehr lesen|hier klicken|nach oben|nächste seite|vorherige seite|zum inhalt|inicio|iniciar sesión|leer más|haga clic aquí|volver arriba|página siguiente|página anterior|ir al contenido)(?:[^a-z\x{80}-\x{10FFFF}]|$)'))
    OR regexp_matches(low, 'all rights reserved|terms of use|privacy policy|cookie policy|use cookies|lorem ipsum|enable javascript|javascript is disabled|follow us on|copyright ©|copyright 19|copyright 20|tous droits réservés|mentions légales|politique de confidentialité|conditions d''utilisation|utilise des cookies|activer javascript|suivez-nous sur|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|verwendet cookies|javascript aktivieren|folgen sie uns|todos los derechos reservados|aviso legal|política de privacidad|términos de uso|condiciones de uso|utiliza cookies|activar javascript|síguenos en') AS fails
  FROM ln2),
l AS (SELECT doc_id, sum(CASE WHEN seen THEN 1 ELSE 0 END) AS dup, sum(CASE WHEN fails THEN k ELSE 0 END) AS lost FROM bad GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, CAST(lost_words AS BIGINT) AS lost_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_words <= 40 * n_words AS kept
FROM b
"""
