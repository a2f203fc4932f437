"""Operator 6: line-first cleaning.

Every line of a text is judged on its own by three kinds of rule: punctuation
(a line that holds no sentence), navigation (menus, breadcrumbs, table rows)
and boilerplate (licences, cookie and copyright notices).  Lines that fail are
removed, and only then is the document judged: it is rejected when what was
removed is too large a share of its words' characters.

Words are runs of characters other than space and \\t \\n \\v \\f \\r; lines are
what ``\\n`` separates.  Defined results:

* null or empty text: all counts 0, ``base_failed`` true, ``kept`` false,
  cleaned text "" (null stays null);
* very long texts are read whole, in memory linear in their length;
* repeated rows and extra columns do not matter: rows are judged one by one and
  the answer holds only the columns named below;
* an empty table gives an empty answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()

#: Phrases of boilerplate, in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie",
    "licensed under", "subscribe to our", "sign up for", "click here", "powered by",
    "javascript", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutz", "nutzungsbedingungen", "impressum", "lizenziert unter",
    "newsletter abonnieren", "hier klicken",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation",
    "sous licence", "abonnez-vous", "cliquez ici",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "condiciones de uso",
    "bajo licencia", "suscríbete", "haga clic aquí",
)


@dataclass(frozen=True)
class LineRules:
    """``max_lost``: share of word characters that a document may lose; ``max_symbols``: of a line's characters.

    A line is boilerplate when phrases are at least ``boilerplate_share`` of its characters, so
    that a paragraph may mention one: the share is the same at every length.
    """

    max_lost: float = 0.5
    max_symbols: float = 0.1
    shouting: float = 0.8
    short_line: int = 4
    boilerplate_share: float = 0.05
    boilerplate: tuple[str, ...] = field(default=BOILERPLATE)


class LineJudge:
    def __init__(self, rules: LineRules):
        self.rules = rules
        self.boilerplate = re.compile("|".join(map(re.escape, rules.boilerplate)), re.I)
        self.sentence_end = re.compile(r"[.!?…。！？](?=[\"'”’»)\]]*(?:\s|$))")
        self.menu = re.compile(r"(?:\s[|»›>]\s.*){3}")
        self.link = re.compile(r"\s*(?:home|menu|login|search|next|previous|share)\b[\s|>»]*$", re.I)
        self.phrases = tuple(p.lower() for p in rules.boilerplate)
        self.latin = all(c <= "ÿ" and c != "µ" for p in rules.boilerplate for c in p)

    def may_hold_phrases(self, text: str) -> bool:
        """False only if the pattern, which ignores case, finds nothing in the text: a fast look at whole texts, of which most hold no phrase."""
        low = text.lower()
        if not self.latin or len(low) != len(text) or "ſ" in text or "ı" in text:  # letters that the pattern takes for others and lower() does not
            return True
        return any(p in low for p in self.phrases)

    def failed(self, line: str, phrases: bool = True) -> str | None:
        """The rule that a line with words fails, or None; ``phrases``: whether its text may hold any."""
        n, raw = len(line), line.encode("utf-8", "surrogatepass")
        if counted(raw, SYMBOLS) > self.rules.max_symbols * n:
            return "symbols"
        if (sum(map(line.count, "|»›>")) >= 3 and self.menu.search(line)) or self.link.match(line):
            return "navigation"
        if phrases and sum(map(len, self.boilerplate.findall(line))) >= max(1, self.rules.boilerplate_share * n):
            return "boilerplate"
        if line.count("!!") >= 3 or (n >= 20 and self.shouts(line, raw)):
            return "shouting"
        if not self.sentence_end.search(line) and len(line.split()) < self.rules.short_line:
            return "punctuation"
        return None

    def shouts(self, line: str, raw: bytes) -> bool:
        if len(raw) == len(line):
            return counted(raw, UPPER) > self.rules.shouting * counted(raw, LETTERS)
        return sum(map(str.isupper, line)) > self.rules.shouting * sum(map(str.isalpha, line))


def counted(raw: bytes, some: bytes) -> int:
    """How many of the bytes are among ``some``."""
    return len(raw) - len(raw.translate(None, some))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight that occurs twice or more in the text."""
    m = len(words) - WINDOW + 1
    if m < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) > len(words) - WINDOW:  # a repeated window repeats eight words
        if len(known) == len(words):
            return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(m, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[j : j + m]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    left, right = order[:-1][same], order[1:][same]
    window = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    if not (window[left] == window[right]).all():  # two windows share a hash: count them as they are
        seen: dict[tuple, int] = {}
        for i in range(m):
            seen[w] = seen.get(w := tuple(ids[i : i + WINDOW]), 0) + 1
        hit = np.fromiter((seen[tuple(ids[i : i + WINDOW])] > 1 for i in range(m)), bool, m)
    else:
        hit = np.zeros(m, bool)
        hit[left] = hit[right] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[np.flatnonzero(hit)] += 1
    cover[np.flatnonzero(hit) + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def judge_text(text: str | None, judge: LineJudge) -> dict:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, dup, kept_lines, lost, total = set(), 0, [], 0, 0
    phrases = judge.may_hold_phrases(text or "")
    for line in (text or "").split("\n"):
        body = line.encode("utf-8", "surrogatepass").split()
        if not body:
            kept_lines.append(line)
            continue
        dup += line in seen
        seen.add(line)
        chars = sum(len(x.decode("utf-8", "surrogatepass")) for x in body) if not line.isascii() else sum(map(len, body))
        total += chars
        if judge.failed(line, phrases) is None:
            kept_lines.append(line)
        else:
            lost += chars
    n_words, n_repeat = len(words), repeated_words(words)
    base_failed = n_words < 20 or 100 * n_repeat > 30 * n_words
    return {
        "n_words": n_words, "word_chars": total, "n_symbols": counted(raw, SYMBOLS), "n_dup_lines": dup, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": not base_failed and lost <= judge.rules.max_lost * total, "lost_chars": lost,
        "clean_text": None if text is None else "\n".join(kept_lines),
    }


COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "lost_chars": pa.int64(), "clean_text": pa.string(),
}
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost_chars bigint"


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per document: the base counts, the verdict, and the text without its failed lines."""
    names = [n for n in COLUMNS if with_text or n != "clean_text"]
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = LineJudge(rules)
        for batch in batches:
            rows = [judge_text(t, judge) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[n] for r in rows], COLUMNS[n]) for n in names)], ["doc_id", *names]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), SCHEMA + ", clean_text string" * with_text)
