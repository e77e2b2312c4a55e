"""Sentence boundaries across languages and scripts.

A text is divided at blank lines and into list items (a line with a marker is
one unit) and running blocks. In a block every run of end marks is a candidate,
in Thai every white space between two Thai characters. Quotations and brackets
are paired first: nothing inside them divides, and a quotation or bracket that
ends with an end mark is a candidate as a whole.

Full stops are ambiguous (abbreviations, initials, ordinals, numbers). They are
classified by a maximum-entropy model over the neighbouring tokens, case,
length, digits and script. Its counts (how often a token ends a block, how often
a token begins one) are taken over all tokens of all documents and kept in
``BUCKETS`` hashed cells a side, so the model has one size whatever the
vocabulary; the weights are fitted on at most ``TRAIN_ROWS`` reliable cases:
block ends are boundaries, stops before a small letter, digit or comma and after
tokens that never end a block are none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reliable cases the weights are fitted on, hashed cells of counts a side.
TRAIN_ROWS, BUCKETS = 40_000, 1 << 20

STOPS = "。！？।॥؟!?‼⁇⁈⁉｡"
#: The Greek question mark is written as a semicolon or U+037E.
SEMICOLONS = ";\u037e"
ENDS = re.compile(f"(?:\\.|\u2026|[{STOPS}{SEMICOLONS}])(?:[.\u2026{STOPS}{SEMICOLONS}]|[ \u00a0\u202f](?=[!?]))*|(?<=[\u0e00-\u0e7f])\\s+(?=[\u0e00-\u0e7f])")
MARKER = re.compile(r"[^\S\r\n]*(?:(\d{1,4})[.)]|[*•‣◦▪\-])[^\S\r\n]+(?=\S)")
PAIRS = {"„": "“”", "“": "”", "‟": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]", "【": "】", '"': '"', "＂": "＂"}
QUOTES, PAIR_MARKS = set('„“‟«‹「『《"＂'), re.compile("[„“”‟«»‹›「」『』《》()（）\\[\\]【】\"＂]")
CLOSERS = "”»›」』》)）]】\"'’"
NOTE = re.compile(r"\s*\[\d{1,4}\](?!\w)")
SPACE = re.compile(r"\s*")
#: Characters that no token before a stop holds.
TOKEN_BREAKS = frozenset('„“”«»「」『』（）()[]"，。、：；' + "".join(c for c in map(chr, range(0x3001)) if c.isspace()))
AFTER = re.compile(r"[^\s.,;:!?…。，、：；！？()（）“”«»「」\"„]*")
LATIN_END = re.compile(r"[\x00-\u024f]*$")
OTHER_WORD = re.compile(r"[A-Za-z0-9_.,]+\s*([^\W\d_])")
#: Common abbreviations of the languages met, a prior for small collections (fixed values).
LISTED = frozenset(
    "dr prof mr mrs ms st no nr fig figs eq eqs tab sect sec ch vol pp approx dept vs jan feb mar apr jun jul aug sep sept oct nov dec al e.g i.e a.m cf "
    "bzw ca vgl abb kap s fr hr z.b d.h u.a ff "
    "env chap n p mme m "
    "sr sra dra núm pág cap aprox véase ej p.ej "
    "см рис разд табл ср стр ок г ч мин ед т.е "
    "κ βλ σχ κεφ δηλ π.χ "
    "د डॉ प्रो सं".split()
)


NUMBER = re.compile(r"\d+")

#: German words before an ordinal number, which is written with a full stop (fixed values).
ARTICLES = frozenset("der die das den dem des im am vom zum zur beim".split())


def _digits(token: str) -> str:
    return token.lower() if token.isalpha() else NUMBER.sub("9", token.lower())


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x600 <= o < 0x780 or 0xFB50 <= o < 0xFE00:
        return "arabic"
    if 0x900 <= o < 0x980:
        return "devanagari"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x3000 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0xFF00 <= o < 0xFFF0 or o >= 0x20000:
        return "cjk"
    return "other"


def spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost paired quotations and brackets within start..end, in one pass; marks without a partner are ignored.

    A mark closes the innermost open one where it can. Else it opens, where a
    partner follows; else it closes the nearest open mark that fits, and marks
    opened since have no partner. Pairs found inside such marks stay.
    """
    marks = [(m.start(), m.group()) for m in PAIR_MARKS.finditer(text, start, end)]
    if not marks:
        return []
    last = {c: at for at, c in marks}
    stack: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {}  # closing mark: heights in the stack of the marks that it closes
    found: list[tuple[int, int]] = []
    for at, c in marks:
        if stack and c in PAIRS[stack[-1][0]]:
            height = len(stack) - 1
        elif c in PAIRS and any(last.get(x, -1) > at for x in PAIRS[c]):
            for x in PAIRS[c]:
                waiting.setdefault(x, []).append(len(stack))
            stack.append((c, at))
            continue
        elif waiting.get(c):
            height = waiting[c][-1]
        else:
            continue
        begin = stack[height][1]
        while len(stack) > height:
            for x in PAIRS[stack.pop()[0]]:
                waiting[x].pop()
        while found and found[-1][0] > begin:  # inside this one
            found.pop()
        found.append((begin, at))
    return found


def bucket(token: str) -> int:
    """The cell of a token's counts."""
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


#: Entries after which a worker's table of worked-out scores begins anew; it holds no data of its own.
CACHED = 200_000


@dataclass
class Model:
    """Counts of tokens before a stop (seen, at a block's end) and after one (seen, at a block's start) by cell, and the weights."""

    before: tuple[np.ndarray, np.ndarray] | None = None  # cells in ascending order, their counts
    after: tuple[np.ndarray, np.ndarray] | None = None
    before_rate: float = 0.15
    after_rate: float = 0.15
    weights: np.ndarray | None = None
    known: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def named_weights(self) -> dict[str, float]:
        return FEATURES if self.weights is None else dict(zip(FEATURES, map(float, self.weights)))

    def _counts(self, side: tuple[np.ndarray, np.ndarray] | None, token: str) -> tuple[int, int]:
        if side is None:
            return 0, 0
        cell = bucket(token)
        at = int(side[0].searchsorted(cell))
        if at == len(side[0]) or side[0][at] != cell:
            return 0, 0
        n, hits = side[1][at]
        return int(n), int(hits)

    def end_odds(self, token: str) -> float:
        n, ends = self._counts(self.before, token)
        return max(-4.0, min(2.0, math.log((ends + 1) / (n * self.before_rate + 1))))

    def start_odds(self, token: str) -> float:
        n, starts = self._counts(self.after, token)
        return max(-4.0, min(2.0, math.log((starts + 1) / (n * self.after_rate + 1))))

    def begins(self, token: str) -> bool:
        """Whether a token is known to begin blocks, not much less than others do."""
        return self._counts(self.after, token)[1] > 0 and self.start_odds(token) > -2.5

    def never_ends(self, token: str) -> bool:
        n, ends = self._counts(self.before, token)
        return ends == 0 and n * self.before_rate >= 8

    def score(self, side: Callable, *x: str) -> float:
        """Weighted sum of the features of one side of a stop, worked out once a token."""
        got = self.known.get(x)
        if got is None:
            w = self.known.setdefault("weights", None) or self.named_weights()
            if len(self.known) > CACHED:
                self.known.clear()
            self.known["weights"] = w
            got = self.known[x] = sum(w[name] * value for name, value in side(self, *x))
        return got


#: Names of the features and the prior mean of their weights.
FEATURES = {
    "bias": 0.5, "end_odds": 1.5, "start_odds": 1.0, "next_lower": -4.0, "next_small": -0.5, "next_upper": 1.5, "next_digit": -2.5, "next_open": 2.0, "next_bracket": 0.5, "next_caseless": 1.0, "next_other": -4.0,
    "initial": -3.0, "listed": -3.0, "inner_stop": -0.5, "number": 0.0, "ordinal": -3.0, "short": -0.3, "capital": 0.0, "joined": 0.0, "latin": 0.0, "cyrillic": 0.0, "greek": 0.0, "arabic": 0.0, "devanagari": 0.0,
}
PRIOR = np.array(list(FEATURES.values()))
AT = {k: i for i, k in enumerate(FEATURES)}


def before_token(text: str, start: int, at: int) -> tuple[str, str]:
    """The token before a stop at ``at`` as written, and its key: a number goes with the word before it."""
    i = at
    while i > start and text[i - 1] not in TOKEN_BREAKS:
        i -= 1
    token = text[i:at]
    if token and token[-1].isascii() and not token.isascii():  # a Latin word or number right after another script
        token = LATIN_END.search(token).group() or token
        i = at - len(token)
    key = _digits(token)
    if not key.strip("9.,"):
        j = i
        while j > start and text[j - 1].isspace():
            j -= 1
        k = j
        while k > start and not text[k - 1].isspace():
            k -= 1
        key = f"{_digits(text[k:j])} {key}"
    return token, key


def after_token(text: str, at: int, end: int) -> tuple[str, str]:
    """First character after white space, and the key of the token there."""
    i = SPACE.match(text, at, end).end()
    if i >= end:
        return "", ""
    j = AFTER.match(text, i, end).end()
    return text[i], _digits(text[i : max(j, i + 1)])


def left_features(model: Model, token: str, key: str) -> list[tuple[str, float]]:
    """The features of what stands before a stop that aren't 0."""
    out = [("bias", 1.0), ("end_odds", model.end_odds(key))]
    if len(token) == 1 and token.isalpha():
        out.append(("initial", 1.0))
    if token.lower() in LISTED:
        out.append(("listed", 1.0))
    if "." in token:
        out.append(("inner_stop", 1.0))
    if token[-1:].isdigit():
        out.append(("number", 1.0))
        if key.partition(" ")[0] in ARTICLES and token.isdigit():
            out.append(("ordinal", 1.0))
    if 1 < len(token) <= 3 and token.isalpha():
        out.append(("short", 1.0))
    if token[:1].isupper():
        out.append(("capital", 1.0))
    script = _script(token[-1]) if token else "other"
    if script in AT:
        out.append((script, 1.0))
    return out


def right_features(model: Model, char: str, following: str, joined: str) -> list[tuple[str, float]]:
    """The features of what stands after a stop; ``joined`` isn't empty where no space does."""
    out = [("start_odds", max(model.start_odds(following), -1.0))]  # many words begin sentences but seldom blocks
    kind = "next_other"
    if char.isdigit():
        kind = "next_digit"
    elif char in QUOTES or (char and char in "¿¡"):
        kind = "next_open"
    elif char and char in "([（":
        kind = "next_bracket"
    elif char.isalpha():
        # A small letter speaks against a boundary, less so where the token is known to begin blocks (a variable's name).
        kind = ("next_small" if model.begins(following) else "next_lower") if char.islower() else "next_upper" if char.isupper() or char.istitle() else "next_caseless"
    out.append((kind, 1.0))
    if joined:
        out.append(("joined", 1.0))
    return out


def features(model: Model, token: str, key: str, char: str, following: str, joined: bool) -> np.ndarray:
    x = np.zeros(len(AT))
    for name, value in left_features(model, token, key) + right_features(model, char, following, "j" if joined else ""):
        x[AT[name]] = value
    return x


def is_boundary(model: Model, token: str, key: str, char: str, following: str, joined: bool) -> bool:
    """The model's decision on a stop."""
    return model.score(left_features, token, key) + model.score(right_features, char, following, "j" if joined else "") > 0


def _stop_divides(model: Model, text: str, start: int, at: int, rest: int, end: int, char: str, following: str) -> bool:
    """Whether the full stop at ``at`` ends a sentence; ``rest`` is where the text goes on, with ``char`` and ``following``."""
    joined = not text[rest].isspace()
    # Without a space only a capital, an opening mark or a change to a script without case can begin a sentence.
    if joined and not (char.isupper() or char in QUOTES or char in "¿¡" or (char.isalpha() and not char.islower() and _script(char) != "latin")):
        return False
    token, key = before_token(text, start, at)
    if joined:
        if len(token) < 2 or (char.isupper() and not (text[rest + 1 : rest + 2].islower() or text[rest + 1 : rest + 2] in " \u00a0'\u2019")):
            return False
    if (char.isdigit() or (char.islower() and char.isascii())) and token and token.lower() not in LISTED and not model.never_ends(key):
        # A number or name that begins a sentence of another script.
        word = OTHER_WORD.match(text, text.index(char, rest), end)
        if word and _script(word.group(1)) not in (_script(token[-1]), "latin", "other"):
            return True
    return is_boundary(model, token, key, char, following, joined)


def _divides(model: Model, text: str, start: int, block: tuple[int, int], mark: tuple[int, int], rest: int, quoted: str, at_start: bool) -> bool:
    """Whether a candidate ends the unit that began at ``start``; ``quoted``: the opening mark whose span it closes."""
    end = block[1]
    marks = text[mark[0] : mark[1]]
    if marks.isspace():  # Thai
        return True
    if rest >= end:
        return True
    joined = not text[rest].isspace()
    char, following = after_token(text, rest, end)
    if not char or char in ",،，、;；:：" or (char in "—–-" and not joined) or (char in "—–" and joined):
        return not char
    if quoted:
        here, there = _script(text[mark[0] - 1]), _script(char)
        if quoted in QUOTES and here == "cjk" and char == "と":
            return False
        if quoted in QUOTES and at_start and not marks.startswith((".", "。", "।")):
            # A question or call in quotes, then who said it: scripts without case don't show it by a small letter.
            inside = {_script(c) for c in text[start : mark[0]] if c.isalpha()}
            if inside & {"cjk", "devanagari", "arabic", "thai"} and there in ("latin", "cjk", "devanagari", "arabic", "thai"):
                return False
        if quoted not in QUOTES and not at_start:
            return False  # an aside within a sentence
        if char.islower():
            return model.begins(following) or here == "cjk"
        return True
    if marks == ".":
        return _stop_divides(model, text, start, mark[0], rest, end, char, following)
    if any(c in STOPS for c in marks):
        return not (joined and char.isalnum() and char.isascii() and not char.isupper() and marks[-1] in "!?")
    if marks[0] in SEMICOLONS:
        return any(_script(c) == "greek" for c in text[start : mark[0]] if c.isalpha()) and (not joined)
    # an ellipsis
    if _script(text[mark[0] - 1]) == "cjk" or char.islower() or char.isdigit():
        return False
    return not joined or char.isupper()


def _close(text: str, at: int, end: int) -> int:
    while at < end and text[at] in CLOSERS:
        at += 1
    return at


def divide(model: Model, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Units of a running block."""
    pairs = spans(text, start, end)
    p, unit, done = 0, start, start
    notes = text.find("[", start, end) >= 0
    while unit < end and text[unit].isspace():
        unit += 1
    for m in ENDS.finditer(text, start, end):
        a, b = m.span()
        if a < done:
            continue
        space = text[a].isspace()  # Thai
        while p < len(pairs) and pairs[p][1] < a:
            p += 1
        quoted, at_start, rest = "", False, b
        if p < len(pairs) and pairs[p][0] < a:
            open_, close = pairs[p]
            if not all(c in CLOSERS or c.isspace() for c in text[b:close]):
                continue
            quoted, rest = text[open_], close + 1
            at_start = open_ == unit
        elif not space:
            rest = b
            while rest < end and text[rest] in CLOSERS and (p >= len(pairs) or pairs[p][0] != rest):
                rest += 1
        if quoted:
            nxt = ENDS.match(text, rest, end)
            if nxt and not nxt.group().isspace():
                done = rest  # the mark after the quotation decides
                continue
        note = NOTE.match(text, rest, end) if notes else None
        while note and not space:
            rest = note.end()
            note = NOTE.match(text, rest, end)
        if _divides(model, text, unit, (start, end), (a, b), rest, quoted, at_start):
            stop = a if space else rest
            if stop > unit:
                yield unit, stop
            unit = done = max(rest, b)
            while unit < end and text[unit].isspace():
                unit += 1
        elif quoted:
            done = rest
    stop = end
    while stop > unit and text[stop - 1].isspace():
        stop -= 1
    if stop > unit:
        yield unit, stop


LINE = re.compile(r"[^\r\n\u2028\u2029]*(?:\r\n|[\r\n\u2028\u2029]|$)")


def blocks(text: str, ended: bool = True, model: Model | None = None) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is item) of running blocks and list items, without outer white space.

    A numbered line is an item where a block begins, after another item, or
    after a line that ends a sentence; elsewhere it goes on with its sentence.
    """
    model = model or Model()
    run = last = -1
    item = False
    for m in LINE.finditer(text):
        a, b = m.span()
        if a == b:
            continue
        line = text[a:b]
        body = line.strip()
        if not body:
            if run >= 0:
                yield run, last, False
            run, item = -1, False
            continue
        first = a + len(line) - len(line.lstrip())
        mark = MARKER.match(text, a, b)
        if mark and run >= 0 and mark.group(1) and not _line_ends(model, text, run, last):
            mark = None
        if mark:
            if run >= 0:
                yield run, last, False
            yield first, a + len(line.rstrip()), True
            run, item = -1, True
            continue
        item = False
        if run < 0:
            run = first
        last = a + len(line.rstrip())
    if run >= 0:
        yield run, last, False


def _greek_before(text: str, start: int, at: int) -> bool:
    """Whether a Greek letter stands between the end mark before ``at`` and ``at``."""
    i = at
    while i > start and text[i - 1] not in "." + STOPS + SEMICOLONS:
        i -= 1
        if _script(text[i]) == "greek":
            return True
    return False


def _line_ends(model: Model, text: str, start: int, end: int) -> bool:
    """Whether the running text start..end ends a sentence, as it must before a numbered item."""
    i = end
    open_ = text.rfind("[", start, end) if text[end - 1] == "]" else -1
    if open_ >= 0 and NOTE.fullmatch(text, open_, end):
        i = open_
        while i > start and text[i - 1].isspace():
            i -= 1
    closed = False
    while i > start and (text[i - 1] in CLOSERS + "“" or (closed and text[i - 1].isspace())):
        i, closed = i - 1, True
    if i <= start:
        return False
    c = text[i - 1]
    if c in STOPS or c in "…" or (c in SEMICOLONS and _greek_before(text, start, i - 1)) or _script(c) == "thai":
        return True
    if c != ".":
        return False
    if closed or text[i - 2 : i - 1] == ".":
        return True
    token, key = before_token(text, start, i - 1)
    return is_boundary(model, token, key, "A", "", False)  # an item may begin in any way


def sentences(model: Model, text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit of a text in order; none for null, empty and blank texts."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for a, b, item in blocks(text, True, model):
        if item:
            out.append((a, b))
        else:
            out.extend(divide(model, text, a, b))
    return out


# --- counts and training ----------------------------------------------------


def _stops(text: str, found: list[tuple[int, int, bool]]) -> Iterator[tuple[int, int, int, int, bool]]:
    """(block start, stop, rest, block end, last in block) of single full stops outside quotations and brackets."""
    for a, b, item in found:
        pairs, p = spans(text, a, b), 0
        for m in ENDS.finditer(text, a, b):
            if m.group() != ".":
                continue
            s, e = m.span()
            while p < len(pairs) and pairs[p][1] < s:
                p += 1
            if p < len(pairs) and pairs[p][0] < s:
                continue
            final = e >= b
            if e < b and not text[e].isspace():
                continue
            if item and not final and text[a:s].strip().isdigit():
                continue  # the marker
            yield a, s, e, b, final


def count(text: str) -> Counter:
    """Counts of one text: ("b", key, ends a block) and ("a", key, begins a block)."""
    out: Counter = Counter()
    found = list(blocks(text))
    for a, s, e, b, final in _stops(text, found):
        out["b", before_token(text, a, s)[1], final] += 1
        if not final:
            out["a", after_token(text, e, b)[1], False] += 1
    for a, b, item in found:
        mark = MARKER.match(text, a, b) if item else None
        out["a", after_token(text, mark.end() if mark else a, b)[1], True] += 1
    return out


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        total: Counter = Counter()
        for text in frame["text"]:
            if text:
                total.update(count(text))
        cells: dict[tuple[str, int], list[int]] = {}
        for (side, token, final), n in total.items():
            c = cells.setdefault((side, bucket(token)), [0, 0])
            c[0] += n
            c[1] += n if final else 0
        yield pd.DataFrame([(*k, *v) for k, v in cells.items()], columns=["side", "cell", "n", "f"])


def reliable_cases(model: Model, text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """Features of the stops of a text whose nature is plain; a block's end is shown with the beginning of the next block."""
    found = list(blocks(text))
    begins = {}
    for (a, b, _), (c, d, item) in zip(found, found[1:] + found[:1]):
        mark = MARKER.match(text, c, d) if item else None
        begins[a] = after_token(text, mark.end() if mark else c, d)
    for a, s, e, b, final in _stops(text, found):
        token, key = before_token(text, a, s)
        if final:
            char, following = begins[a]
            if char.isalpha() and char.islower():
                continue
            yield features(model, token, key, char, following, False), True
        else:
            char, following = after_token(text, e, b)
            if char.islower() and model.start_odds(following) < -1 or char.isdigit() or char in ",،":
                yield features(model, token, key, char, following, False), False
            elif model.never_ends(key):
                yield features(model, token, key, char, following, False), False


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 0.02) -> np.ndarray:
    """Penalised maximum likelihood by Newton steps; the penalty draws to the prior weights."""
    w = PRIOR.copy()
    if not len(x):
        return w
    strength = np.full(x.shape[1], max(pull * len(x) ** 0.5, 1.0))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(strength), x.T @ (y - p) - strength * (w - PRIOR))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(documents: DataFrame) -> Model:
    """Fit on ``documents`` (doc_id, text). Counts cover all documents; without any usable text the prior weights stand."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    counted = texts.select("text").mapInPandas(_counted, "side string, cell long, n long, f long").groupBy("side", "cell").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    got = counted.toPandas()  # at most BUCKETS cells a side
    model, stops = Model(), 0
    for side, name in (("b", "before"), ("a", "after")):
        of = got[got["side"] == side].sort_values("cell")
        setattr(model, name, (of["cell"].to_numpy(np.int64), of[["n", "f"]].to_numpy(np.int64)))
        if len(of):
            setattr(model, f"{name}_rate", int(of["f"].sum()) / max(int(of["n"].sum()), 1))
        stops = stops or int(of["n"].sum())
    held = spark.sparkContext.broadcast(model)

    def cases(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                for i, (x, y) in enumerate(reliable_cases(held.value, text)):
                    rows.append((zlib.crc32(f"{doc}/{i}".encode()), x.tolist(), y))
            yield pd.DataFrame(rows, columns=["o", "x", "y"])

    # A share of documents, by hash, that gives about TRAIN_ROWS cases at most.
    share = min(1.0, 2.0 * TRAIN_ROWS / max(stops, 1))
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    got = some.mapInPandas(cases, "o long, x array<double>, y boolean").orderBy("o").limit(TRAIN_ROWS).toPandas()
    if len(got):
        model.weights = fit_weights(np.array(got["x"].tolist()), got["y"].to_numpy(float))
    return model


def sentence_units(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every unit of every document, in Unicode characters from 0, end not included."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [sentences(held.value, text) for text in frame["text"]]
            units = np.array([u for of in found for u in of], np.int32).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": np.repeat(frame["doc_id"].to_numpy(np.int64), [len(of) for of in found]), "sent_start": units[:, 0], "sent_end": units[:, 1]})

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(run, "doc_id long, sent_start int, sent_end int")
