"""Garbled text from wrong character encoding (problem 9).

Method: best-first graph search. A state is the text of a garbled span; the edges
are encode/decode pairs and unescaping; states already seen are kept by hash; the
queue is ordered by a character-plausibility cost, and the search ends with the
cheapest text it can reach. Spans are searched once per worker and remembered, as
the same few thousand spans make up nearly all the damage of a corpus.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import keyed, schema_of, unkeyed

#: Code pages a text is commonly mistaken for (fixed values).
PAGES = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254")
#: Pairs of the page a text was read in and the one it was written in, beside UTF-8, where
#: the right text is of another alphabet: between two Latin pages both look like prose.
CROSSED = (
    ("latin-1", "cp1251"), ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("latin-1", "koi8_r"), ("cp1252", "koi8_r"),
    ("latin-1", "gbk"), ("cp1252", "gbk"), ("latin-1", "shift_jis"), ("cp1252", "shift_jis"), ("latin-1", "euc_kr"), ("cp1252", "euc_kr"),
)
#: The letters a text in such a page is made of.
LETTERS = {"cp1251": "[а-яёА-ЯЁ]+", "koi8_r": "[а-яёА-ЯЁ]+", "gbk": "[\u4e00-\u9fff\u3000-\u3002\uff01-\uff1f]+", "shift_jis": "[\u3040-\u30ff\u4e00-\u9fff\u3000-\u3002\uff01-\uff1f]+", "euc_kr": "[가-힣]+"}
#: First bytes of the common characters (level one) in GB 2312 and in Shift JIS.
COMMON_HAN = {"gb2312": range(0xB0, 0xD8), "shift_jis": range(0x88, 0x98)}
REFERENCE = r"&(?:#[0-9]{3,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{4,8});"
SPAN = re.compile(rf"(?:[^\x00-\x7f]|{REFERENCE})+")
ESCAPE = re.compile(REFERENCE)
#: Signs that well-formed prose uses (fixed values).
PROSE = frozenset("‘’‚“”„«»‹›–—…•·€£¥¢©®™°±§¶¿¡ªº²³¹½¼¾×÷†‡‰′″−→←↑↓≤≥≠√∞")
LEADS = frozenset("ÂÃâÄÅÐÑĂĐГВРСв√├┬Γ‚¬")
_hybrid = {p: {bytes([b]).decode(p, "ignore") or chr(b): b for b in range(128, 256)} for p in PAGES}
#: What a text of two-byte characters looks like when it is read byte by byte: a second
#: byte may be an ASCII sign.
WIDE = re.compile(r"(?:[\x80-\xff\u0152-\u0192\u02c6-\u02dc\u2013-\u203a\u20ac\u2122][@-~]?){2,}")
#: A first byte of Shift JIS that prose does not hold.
WIDE_SIGN = re.compile("[‚ƒ\x80-\x9f]")
#: Runs of accented letters as no language has them.
CROWD = re.compile("[À-ÖØ-öø-ÿŒœŠšŽžŸ]{3,}")
FOREIGN = re.compile("[Ͱ-ϿЀ-ӿ]{3,}|[\u0530-֏]{3,}|[\u0590-ۿ]{3,}|[\u0900-\u0dff]{3,}|[\u0e00-\u0e7f]{3,}|[Ⴀ-ჿ]{3,}|[\u3040-\u9fff가-힣]{2,}")
LATIN_HOME = re.compile("[À-ÖØ-öø-ÿŒœŠšŽžŸ]")


def encode(text: str, page: str) -> bytes | None:
    """Bytes of ``text`` in ``page``; bytes that the page leaves undefined stand for themselves."""
    own, out = _hybrid[page], bytearray()
    for ch in text:
        b = ord(ch) if ch < "\x80" else own.get(ch, ord(ch) if "\x80" <= ch <= "\x9f" else None)
        if b is None:
            return None
        out.append(b)
    return bytes(out)


def _lead(ch: str, page: str) -> int:
    return (ch.encode(page, "ignore") or b"\0")[0]


def _char_cost(ch: str) -> float:
    if ch < "\x80":
        return 0.1
    if ch == "\ufffd" or "\x80" <= ch <= "\x9f":
        return 12
    if LATIN_HOME.match(ch):
        return 1
    if "\u3400" <= ch <= "\u9fff":
        return 8 if any(_lead(ch, page) in first for page, first in COMMON_HAN.items()) else 11
    if ch in PROSE:
        return 1.2
    kind = unicodedata.category(ch)
    if kind[0] == "L":
        # Latin letters of more languages, single Greek symbols; see cost() for others
        return 2.5 if ch < "ƀ" or "Ͱ" <= ch <= "Ͽ" else 8
    if ch in "\xa0\xad":
        return 2
    return {"M": 8, "N": 3, "P": 2.5, "Z": 4, "S": 5}.get(kind[0], 12)


def cost(text: str) -> float:
    """Implausibility of a span: its characters, and letters of different alphabets
    or letters and signs run together. Letters of a foreign alphabet are plausible
    as words of three or more, but not one by one."""
    text = ESCAPE.sub("\ufffe", text)
    total, last = 0.0, ""
    for ch in text:
        total += _char_cost(ch)
        if last and last > "\x7f" and ch > "\x7f":
            a, b = last.isalpha(), ch.isalpha()
            if a != b or a and (last < "ɐ") != (ch < "ɐ"):
                total += 1.5
        last = ch
    for run in FOREIGN.findall(text):
        # rare characters stay dearer than common ones, and capitals within a word than small letters
        odd = sum(_char_cost(c) > 8 for c in run)
        total -= sum(map(_char_cost, run)) - 1.6 * len(run) - 3 * odd - 1.2 * len(re.findall("(?<=[а-яёα-ω])[А-ЯЁΑ-Ω]", run))
    for run in CROWD.findall(text):
        total += 1.5 * (len(run) - 2)
    return total


def crossed(text: str, page: str, written: str) -> str | None:
    """The text as it was written in one page and read in another, if it is made of that
    page's common letters only."""
    raw = encode(text, page)
    try:
        made = raw.decode(written) if raw is not None else ""
    except UnicodeDecodeError:
        return None
    bare = "".join(c for c in made if c > "\x7f")
    return made if re.fullmatch(LETTERS[written], bare) and not any(_char_cost(c) > 8 for c in bare) else None


def _steps(text: str) -> Iterator[tuple[str, str]]:
    if ESCAPE.search(text):
        yield "unescape", html.unescape(text)
    if text.isascii():
        return
    for page in PAGES:
        raw = encode(text, page)
        if raw is None:
            continue
        try:
            yield f"{page}>utf-8", raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
        if page == "latin-1" and any("\x80" <= c <= "\x9f" for c in text):
            yield "latin-1>cp1252", "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
    if len(text) > 3:
        for page, written in CROSSED:
            if (made := crossed(text, page, written)) is not None:
                yield f"{page}>{written}", made


MAX_STATES, MAX_STEPS, PARTS = 200, 6, 64


def search(span: str, max_states: int = MAX_STATES) -> tuple[str, tuple[str, ...], bool]:
    """The cheapest text reachable from ``span``, the operations that lead to it, and
    whether the search stopped at its bounds before it was through.

    Each operation costs a little, so that a text that is plausible stays.
    """
    best, best_cost, best_path = span, cost(span), ()
    heap, seen, order, cut = [(best_cost, 0, span, ())], {hash(span)}, 0, False
    while heap and not cut:
        _, _, text, path = heapq.heappop(heap)
        if len(path) == MAX_STEPS:
            cut = True
            break
        for name, made in _steps(text):
            if hash(made) in seen:
                continue
            seen.add(hash(made))
            order += 1
            c = cost(made) + 0.3 * (len(path) + 1)
            if c < best_cost - 0.2:
                best, best_cost, best_path = made, c, (*path, name)
            heapq.heappush(heap, (c, order, made, (*path, name)))
        cut = bool(heap) and len(seen) > max_states
    return best, best_path, cut


_known: dict[str, tuple[str, tuple[str, ...], bool, bool]] = {}


def _lost(text: str) -> bool:
    """Does a text hold characters that no sound one has?"""
    return "ï»¿" in text or "ï¿½" in text or any(c == "�" or "\x80" <= c <= "\x9f" for c in text)


def repair_span(span: str) -> tuple[str, tuple[str, ...], bool, bool]:
    """(text, operations, garbled?, search cut?). A span with lost characters stays but
    is garbled; what only turns into other garbage stays as it is."""
    got = _known.get(span)
    if got is None:
        text, path, cut = search(span)
        if not path and len(span) > 2:
            # Damage may touch sound characters: search the parts on their own.
            parts, done, i = [], [], 0
            while i < len(span):
                lead = span[i] in LEADS or "\x80" <= span[i] <= "\x9f"
                for j in range(min(len(span), i + PARTS), i + 1, -1) if lead or len(span) <= PARTS else ():
                    made, p, _ = search(span[i:j])
                    if p and (lead or j - i > 2 or i == 0):
                        parts.append(made)
                        done += p
                        i = j
                        break
                else:
                    parts.append(search(span[i])[0])
                    i += 1
            cut = cut or len(span) > PARTS
            if done:
                text, path = "".join(parts), tuple(dict.fromkeys(done))
        if all(p == "unescape" for p in path):
            text, path = span, ()  # a reference is no sign of a wrong encoding
        bad = bool(path) or _lost(span)
        if path and _lost(text) and not _lost(span):
            text, path = span, ()
        if len(_known) > 200_000:
            _known.clear()
        got = _known[span] = (text, path, bad, cut and bad and (not path or _lost(text)))
    return got


def _wide(text: str, used: dict[str, None]) -> str:
    """Stretches of two-byte characters read byte by byte, put right as a whole."""

    def sub(m: re.Match[str]) -> str:
        span = m.group()
        high = sum(c > "\x7f" for c in span)
        if len(span) < 4 or high == len(span) or 2 * high < len(span):
            return span
        best, least = span, cost(span)
        for page, written in CROSSED:
            if written in ("gbk", "shift_jis", "euc_kr") and (made := crossed(span, page, written)) is not None and sum(c > "\x7f" for c in made) > 2:
                if (c := cost(made) + 0.3) < least - 0.2:
                    best, least = made, c
                    used[f"{page}>{written}"] = None
        return best

    return WIDE.sub(sub, text)


def repair(text: str) -> tuple[str, tuple[str, ...], bool, bool]:
    """(restored text, operations used, garbled?, search cut?) of a whole text."""
    steps: dict[str, None] = {}
    whole, spans = text, {x: repair_span(x) for x in set(SPAN.findall(text))}
    if WIDE_SIGN.search(text) and not any(p.endswith(">utf-8") for x in spans.values() for p in x[1]):
        whole = _wide(text, steps)
        if steps:
            spans = {x: repair_span(x) for x in set(SPAN.findall(whole))}
    bad, cut = bool(steps), False
    for _, path, b, c in spans.values():
        bad, cut = bad or b, cut or c
        steps.update(dict.fromkeys(path))
    if not bad:
        return text, (), False, False
    read = [tuple(p.split(">")) for p in steps if p.split(">")[-1] in LETTERS]

    def sub(m: re.Match[str]) -> str:
        made, path, _, _ = repair_span(m.group())
        if not path:
            # short words beside longer ones that were read in the wrong page
            for page, written in read:
                if (other := crossed(m.group(), page, written)) is not None:
                    return other
        return made

    return SPAN.sub(sub, whole), tuple(steps), True, cut


def repair_encoding(df: DataFrame, keys: list[str], text: str, only_garbled: bool = False, with_text: bool = True) -> DataFrame:
    """One row per row of ``df``: keys, ``garbled``, ``operations`` (array), ``search_cut``
    (the search came to its bounds with garbage left) and, with ``with_text``, ``restored``.

    A text without damage comes back as it is; null stays null and is not garbled.
    Replacement characters cannot be restored: they make a text garbled and stay.
    ``only_garbled`` leaves out the sound rows. Extra columns are ignored.
    """
    base = keyed(df, keys, _t=text)
    schema = schema_of(df, keys, "garbled boolean, operations array<string>, search_cut boolean" + ", restored string" * with_text)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [repair(t) for t in batch.column(width).to_pylist()]
            keep = pa.array([i for i, m in enumerate(made) if m[2] or not only_garbled], pa.int64())
            made = [m for m in made if m[2] or not only_garbled]
            cols = [pa.array([m[2] for m in made], pa.bool_()), pa.array([list(m[1]) for m in made], pa.list_(pa.string())), pa.array([m[3] for m in made], pa.bool_())]
            if with_text:
                cols.append(pa.array([m[0] for m in made], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in range(width)] + cols, names=schema.names)

    # Only texts with other than ASCII characters or references can hold damage; the rest pass by.
    other = F.coalesce(F.col("_t").rlike(rf"[^\x00-\x7F]|{REFERENCE}"), F.lit(False))
    out = base.where(other).mapInArrow(run, schema)
    if not only_garbled:
        ks = [f"_k{i}" for i in range(width)]
        sound = base.where(~other).select(*ks, F.lit(False).alias("garbled"), F.array().cast("array<string>").alias("operations"), F.lit(False).alias("search_cut"), *[F.col("_t").alias("restored")] * with_text)
        out = out.unionByName(sound)
    return unkeyed(out, keys)
