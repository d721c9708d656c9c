"""Personal data: spans by fixed patterns, and further spans by a character-level BiLSTM with a CRF.

The tagger learns from labelled spans: windows of a sample of whole documents in which the patterns' spans are labelled,
and into which other ways to write the four kinds are set (addresses with "at" and "dot", national telephone numbers,
parts in brackets or apart), and numbers that are none of them. It reads every character of every text in overlapping
windows, but for those that no span can come from: whatever is added holds a digit, an @ or the word "at", so a window is
passed over if neither it nor one beside it has any. A window whose best path is outside for sure, by a bound on scores and transitions, is done; of the others
together with their neighbours the scores of a character in all its windows are averaged, and one best path over all of
them gives the spans. A span that the tagger adds must not meet one of the patterns and must pass the kind's own test
(Luhn, parts of an address, numbers of digits), so the patterns' rejects are not brought back.

Defined results: a null or empty text has no spans; equal texts have equal spans; with no window to learn from only the
patterns find spans; rows are neither dropped nor merged. Offsets are code points, ends exclusive. Time is in proportion
to a text's length; a text is tagged in parts of PART characters that overlap, and a span belongs to the part in which
it begins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, with_columns
from .tagger import Reader, best_paths, trained

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The bounded sample: documents to learn from, and most characters of one (longer ones are not sampled).
SAMPLE_DOCS, SAMPLE_CHARS = 120, 16_000
#: Characters of a window to learn from and from one to the next, and of a window to be tagged.
LEARN, LEARN_STRIDE, WINDOW, STRIDE = 128, 88, 256, 216
#: Characters of a part of a text, before it, and after it.
PART, BACK, ON = 16_384, 64, 256
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_SIGNS = " \n@.-+()_%=\"':/,;|#*&$!?[]"
_SYMBOLS = 5 + 26 + len(_SIGNS)
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(int(c) * 2 - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def valid(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))
    digits = "".join(_DIGIT.findall(s))
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern of addresses, in linear time: each @ with the run of characters before it."""
    at, last, done = text.find("@"), 0, 0
    while at >= 0:
        before = text[max(last, done) : at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        last = at + 1
        at = text.find("@", last)


def dotted(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four numbers with dots between: every four of a run of such numbers."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            at, numbers = m.start(), m[0].split(".")
            for i in range(0, len(numbers) - 3, 4):
                end = at + sum(map(len, numbers[i : i + 4])) + 3
                yield at, end
                at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the patterns' spans in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in dotted(text) if valid("ip", text[a:b])]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if valid("card", m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if valid("phone", m[0])]
    return sorted(out)


def _codes() -> np.ndarray:
    codes = np.full(129, 3, np.uint8)
    codes[128] = 1  # letters beyond ASCII, for the most part
    codes[ord("0")], codes[ord("1") : ord("9") + 1] = 4, 2
    codes[ord("a") : ord("z") + 1] = codes[ord("A") : ord("Z") + 1] = np.arange(5, 31)
    for i, c in enumerate(_SIGNS):
        codes[ord(c)] = 31 + i
    return codes


_CODES = _codes()


def code_of(text: str) -> np.ndarray:
    """A small code for each character: letters whatever their case, zero, other digits, signs, and others; 0 is beyond the end."""
    return _CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def tags_of(a: int, n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of the characters from a to a + n."""
    tags = np.zeros(n, np.int64)
    for x, k, y in spans:
        if x < a + n and y > a:
            tags[max(0, x - a) : y - a] = 2 + 2 * k
            if x >= a:
                tags[x - a] = 1 + 2 * k
    return tags


def made_up(rng: np.random.Generator, words: list[str]) -> tuple[int, str]:
    """A kind, or -1 for none, and something that is written like it."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: words[rng.integers(len(words))].lower()
    kind = pick(-1, 0, 0, 1, 2, 3)  # addresses have the most forms
    if kind == 0:
        local, domain, end = pick(word(), f"{word()}.{word()}", f"{word()}{number(2)}", f"{word()}.{number(2)}", f"{word()}_{word()}"), pick(word(), f"{word()}-{word()}", f"mail{number(1)}", f"{word()}.{word()}"), pick("com", "org", "net", "de", "fr", "es", "io", "example.com")
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), (" @ ", " . "), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" AT ", " DOT "), (" at ", "."))
        return 0, f"{local}{at}{f'{domain}.{end}'.replace('.', dot)}"
    if kind == 1:
        return 1, pick(".", ".", "[.]", "(.)", " . ", " dot ", "[dot]").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == 2:
        digits = number(15)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        sign = pick("", " ", "-", ".", "/", "_", "  ", " - ", " . ")
        return 2, sign.join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        a, b, c = number(3), number(3), number(4)
        return 3, pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0049 {a} {b}{c}", f"00{number(2)} {a} {b} {c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"0{a}/{b}{c}")
    none = [number(16), f"{number(4)} {number(4)} {number(4)} {number(4)}", f"20{number(2)}-0{number(1)}-1{number(1)}", f"1{number(1)}:{number(2)}:{number(2)}", f"v{number(1)}.{number(2)}.{number(1)}", f"${number(1)},{number(3)}.{number(2)}"]
    none += [f'token = "{bytes(rng.integers(0, 256, 20).astype(np.uint8)).hex()}"', f"page {number(2)} of {number(3)}", f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", number(10), number(13), f"no. {number(5)}", f"{number(3)} at {number(3)}", f"{word()} at {word()}", f"the dot {word()} at", f"{number(2)}%", f"{number(1)}.{number(1)}", f"{number(4)}-{number(4)}", f"#{number(6)}"]
    return -1, none[rng.integers(len(none))]


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[str]:
    """SAMPLE_DOCS whole texts of SAMPLE_CHARS at most, the first in the order of a hash of key and text."""
    rows = docs.filter((F.length(text) > 0) & (F.length(text) <= SAMPLE_CHARS)).select(F.xxhash64(key, text).alias("own"), F.col(text).alias("t"))
    chosen = [r["own"] for r in drawn(rows.select("own"), F.col("own"), SAMPLE_DOCS).select("own").collect()]
    found = rows.filter(F.col("own").isin(chosen)).groupBy("own").agg(F.max("t").alias("t")).collect() if chosen else []
    return [r["t"] for r in sorted(found, key=lambda r: r["own"])]


def labelled(texts: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags (N, LEARN) of the windows of all texts, into most of which one or two things more are set."""
    codes, tags = [], []

    def add(text: str, spans: list[tuple[int, int, int]], s: int) -> None:
        own = code_of(text[s : s + LEARN])
        codes.append(np.pad(own, (0, LEARN - len(own))))
        tags.append(np.pad(tags_of(s, len(own), spans), (0, LEARN - len(own))))

    for text in texts:
        text = f"\n{text}"  # each text begins a line, here and where it is tagged
        spans = base_spans(text)
        words = re.findall(r"[A-Za-z]{2,9}", text[:2000]) or ["name"]
        for s in range(0, max(1, len(text) - LEARN + LEARN_STRIDE), LEARN_STRIDE):
            own, marks, shift = text, spans, 0
            for _ in range(int(rng.choice(3, p=[0.1, 0.4, 0.5]))):
                gaps = [m.end() for m in re.finditer(r"[^\S\n]", own[s : s + LEARN])] or [0]
                at = s + gaps[rng.integers(len(gaps))]
                if rng.random() < 0.3 and (s == 0 or s + LEARN >= len(own)):  # the begin or the end of a text
                    at = 1 if s == 0 and rng.random() < 0.5 else len(own)
                if any(x < at < y for x, _, y in marks):
                    continue
                kind, new = made_up(rng, words)
                tail = ["", ",", ".", ";", " "][rng.integers(5)] + " " if at < len(own) else ""
                if at == len(own) and not own[-1].isspace():
                    own, at = own + " ", at + 1
                shift = len(new) + len(tail)
                marks = [(x + shift * (x >= at), k, y + shift * (x >= at)) for x, k, y in marks] + ([(at, kind, at + len(new))] if kind >= 0 else [])
                own = own[:at] + new + tail + own[at:]
            add(own, marks, s)
    return np.array(codes, np.int64).reshape(-1, LEARN), np.array(tags, np.int64).reshape(-1, LEARN)


def train(texts: list[str], seed: int = 11) -> dict | None:
    """Weights of the tagger from texts, labelled by the patterns and by what is set into them; None without a text."""
    codes, tags = labelled([t for t in texts if t], np.random.default_rng(seed))
    return trained(codes, tags, _SYMBOLS, TAGS) if len(codes) else None


def windows_of(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat codes of all units, each followed by zeros; the unit of each window, and its start in the flat codes."""
    sizes = np.array([len(u) for u in units], np.int64)
    count = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    room = (count - 1) * STRIDE + WINDOW
    first = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()), np.uint8)
    for u, a in zip(units, first.tolist(), strict=True):
        flat[a : a + len(u)] = u
    unit = np.repeat(np.arange(len(units)), count)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
    return flat, unit, first[unit] + nth * STRIDE


def possible(flat: np.ndarray, unit: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The windows that hold a digit, an @ or the word "at", without which nothing matches _WRITTEN, and those beside them."""
    letter = (flat >= _CODES[ord("a")]) & (flat <= _CODES[ord("z")])
    marks = (flat == _CODES[ord("0")]) | (flat == _CODES[ord("1")]) | (flat == _CODES[ord("@")])
    marks[1:-2] |= (flat[1:-2] == _CODES[ord("a")]) & (flat[2:-1] == _CODES[ord("t")]) & ~letter[:-3] & ~letter[3:]
    before = np.concatenate([[0], np.cumsum(marks)])
    return beside(before[starts + WINDOW] > before[starts], unit)


def beside(chosen: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The chosen windows and those next to them in the same unit."""
    out = chosen.copy()
    out[1:] |= chosen[:-1] & (unit[1:] == unit[:-1])
    out[:-1] |= chosen[1:] & (unit[1:] == unit[:-1])
    return out


def tag_units(units: list[np.ndarray], reader: Reader, block: int = 1024) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of each unit of codes."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in units]
    flat, unit, starts = windows_of(units)
    steps = np.arange(WINDOW)
    open_ = np.zeros(len(starts), bool)
    asked = np.flatnonzero(possible(flat, unit, starts))
    for x in range(0, len(asked), block):
        some = asked[x : x + block]
        codes = flat[starts[some] + steps[:, None]]
        open_[some] = reader.undecided(reader.scores(codes), codes)
    need = np.flatnonzero(beside(open_, unit))
    # runs of neighbouring windows of one unit: where each begins in the flat codes, and the sums of its characters
    runs = np.split(need, np.flatnonzero((np.diff(need) > 1) | (np.diff(unit[need]) > 0)) + 1) if len(need) else []
    sums = [np.zeros((int(starts[own[-1]] - starts[own[0]]) + WINDOW, TAGS + 1), np.float32) for own in runs]
    of_run = np.repeat(np.arange(len(runs)), [len(own) for own in runs])
    for x in range(0, len(need), block):
        some = need[x : x + block]
        e = reader.scores(flat[starts[some] + steps[:, None]])
        for c, w in enumerate(some.tolist()):
            run = of_run[x + c]
            at = int(starts[w] - starts[runs[run][0]])
            sums[run][at : at + WINDOW, :TAGS] += e[:, :, c]
            sums[run][at : at + WINDOW, TAGS] += 1
    begins = [int(starts[own[0]] - starts[np.searchsorted(unit, unit[own[0]])]) for own in runs]
    means = [(total[:, :TAGS] / total[:, TAGS:])[: len(units[unit[own[0]]]) - a] for own, total, a in zip(runs, sums, begins, strict=True)]
    for own, begin, path in zip(runs, begins, best_paths(means, reader.step), strict=True):
        u, n = unit[own[0]], len(path)
        for s in np.flatnonzero(path % 2 == 1).tolist():
            end = s + 1
            while end < n and path[end] == path[s] + 1:
                end += 1
            out[u].append((begin + s, (int(path[s]) - 1) // 2, begin + end))
    return out


def tagged(texts: list[str], reader: Reader, most: int = 2 << 20) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger finds in each text, the windows of many texts at a time."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, int]] = []

    def solve() -> None:
        units = [code_of(texts[i][a - BACK : b + ON] if a else f"\n{texts[i][: b + ON]}") for i, a, b in held]
        for (i, a, b), found in zip(held, tag_units(units, reader), strict=True):
            shift, done = a - BACK if a else -1, out[i][-1][2] if out[i] else 0
            out[i] += [(max(x + shift, 0), k, y + shift) for x, k, y in found if a <= max(x + shift, 0) < b and max(x + shift, 0) >= done and y + shift > 0]
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), PART):
            held.append((i, a, min(a + PART, len(t))))
            size += min(PART, len(t) - a) + WINDOW
            if size > most:
                solve()
                size = 0
    if held:
        solve()
    return out


_DOT = r"(?:\s?[(\[]\s?(?:dot|\.)\s?[)\]]\s?|\s+dot\s+|\s?\.\s?)"
#: How the kinds can be written; inside a tagged span the first of these counts.
_WRITTEN = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?|\s+at\s+)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.I),
    "card": re.compile(r"[0-9]{2,}(?:[ .\-/_]{1,3}[0-9]{2,})+"),
    "phone": re.compile(r"(?!97[89]-)[+(]?[0-9]+\)?(?:[ ().\-/]{1,3}[0-9]+){2,}|\(?0[0-9]+\)?(?:[ .\-/]{1,3}[0-9]+)+|\([0-9]+\) ?[0-9]+(?:[ .\-/]{1,3}[0-9]+)+"),
}


def likely(kind: int, s: str) -> bool:
    """Whether something written like a kind passes its test, once "dot" and brackets are signs again."""
    return valid(KINDS[kind], re.sub(_DOT, ".", s, flags=re.I) if KINDS[kind] == "ip" else s)


def added(text: str, found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What is written like its kind inside the tagger's spans, taken to the begin of a word, and meets no base span."""
    out = []
    for a, k, b in found:
        while a > 0 and text[a].isalnum() and (text[a - 1].isalnum() or text[a - 1] in "._-"):
            a -= 1
        while b > a and text[b - 1] in " \n,;:.":
            b -= 1
        if (m := _WRITTEN[KINDS[k]].search(text, a, b)) and likely(k, m[0]):
            x, y = m.span()
            if not (x > 0 and text[x].isalnum() and (text[x - 1].isalnum() or text[x - 1] == "_")) and not (y < len(text) and (text[y].isalnum() or text[y] == "_")):
                out.append((x, k, y))
    if not base or not out:
        return out
    starts, ends = np.array([x for x, _, _ in base]), np.maximum.accumulate([y for _, _, y in base])
    return [s for s in out if (i := int(np.searchsorted(starts, s[2]))) == 0 or ends[i - 1] <= s[0]]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span as its kind in brackets; of spans that meet the first stays and the rest of others goes."""
    out, at = [], 0
    for a, k, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def finder(weights: dict | None) -> Callable[[pa.Array], dict]:
    reader = Reader(weights) if weights is not None else None

    def work(texts: pa.Array) -> dict:
        all_texts = [t or "" for t in texts.to_pylist()]
        base = [base_spans(t) for t in all_texts]
        more: list[list[tuple[int, int, int]]] = [[] for _ in all_texts]
        if reader is not None:
            more = [added(t, found, b) for t, found, b in zip(all_texts, tagged(all_texts, reader), base, strict=True)]
        every = [sorted(b + m) for b, m in zip(base, more, strict=True)]
        out: dict = {f"n_{kind}": pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k, kind in enumerate(KINDS)}
        out["base_sha256"] = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string())
        out["spans"] = pa.array([written(s) for s in every], pa.string())
        out["n_added"] = pa.array([len(m) for m in more], pa.int64())
        out["n_spans"] = pa.array([len(s) for s in every], pa.int64())
        out["masked"] = pa.array([masked(t, s) for t, s in zip(all_texts, every, strict=True)], pa.string())
        return out

    return work


FIELDS = [*((f"n_{k}", "long") for k in KINDS), ("base_sha256", "string"), ("spans", "string"), ("n_added", "long"), ("n_spans", "long"), ("masked", "string")]


def find(df: DataFrame, weights: dict | None, text: str = "text", fields: list[str] | None = None) -> DataFrame:
    """df with the numbers of base spans by kind, base_sha256, all spans, n_added, n_spans and the masked text."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    chosen = [f for f in FIELDS if fields is None or f[0] in fields]
    return with_columns(df, chosen, lambda: finder(shared.value), text)
