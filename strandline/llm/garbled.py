"""Problem 8: text that was decoded with the wrong character encoding.

1. One pass counts the characters of the whole corpus and, once the alphabet is known,
   one more its adjacent pairs. The alphabet has ``OWN`` classes for the most frequent
   characters and one class for every 4,352 code points of the rest, so the pair table has at
   most (OWN + 256)^2 cells whatever the corpus: its size is proven before it is sent to
   the workers.
2. A pair's score is its mutual information with the marginal of its second character,
   I(a;b) + ln P(b): how expected the pair is. Pairs below ``EXPECTED`` count for, ordinary
   pairs against a run being improbable; the maximum-scoring segments (Ruzzo and Tompa)
   of a text are its improbable runs. Clean text has few of them, so little else is done.
3. Inside a run, and its words and line where bytes of garbled characters look like ASCII,
   every inverse mapping (back to bytes by one encoding, read by another) is tested.
   A mapping stands if the result is more probable in this corpus by a margin; that is
   tried again on the result, for text that was garbled more than once. U+FFFD is expected
   nowhere, so it stands in an improbable run; where it took the place of letters the
   passage is garbled, but can't be restored.

Rows never meet in steps 2 and 3 (one ``mapInArrow``); the counts are aggregated per
Arrow batch before they are shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loglines import clean

#: Characters with a class of their own.
OWN = 1792
BLOCK = 0x110000 // 256
CLASSES = OWN + 256
#: Score (nats) below which a pair is unexpected; what an ordinary pair costs a run.
EXPECTED, ORDINARY = -6.0, 1.5
#: A run is only garbled if it has a pair below this score, for a wrongly read character
#: nearly never follows what it stands behind.
RARE = -7.5
#: So much more expected than its marginal a character can be by its predecessor: what
#: garbled text is full of is expected only there.
LIFT = 2.5
#: Total score of a line's runs from which the whole line is read anew too.
LINE_SCORE = 10.0
#: Characters from which a line is read in stretches of that many too, each half over the
#: next, and how far a stretch is widened to a blank.
STRETCH, TO_BLANK = 4000, 400
#: Margins (nats) by which a restored run must be more probable: if the bytes are valid
#: UTF-8, which is seldom an accident, and else in all and per changed character.
MARGIN_UTF8, MARGIN_OTHER, MARGIN_CHAR = 2.5, 14.0, 1.5
#: Most that a character of text is expected to cost (nats), for bounds.
BEST_CHAR = 1.0
#: Part of a conditional probability that is the marginal's; least probability.
MIXED, LEAST = 0.01, 2e-7
#: Score of a pair with a replacement character.
NEVER = float(np.log(LEAST))

# --- fixed values: names of encodings ----------------------------------------------
#: Encodings by which text was wrongly read, and those in which it may have been written.
WRONG = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "cp866", "koi8-r", "gb18030", "cp932", "euc_jp", "big5", "cp949", "cp1254", "cp1253", "cp852", "iso8859-5", "iso8859-9", "cp1257", "mac_cyrillic", "mac_latin2", "koi8-u", "cp1255", "cp1256", "cp874"]
RIGHT = ["utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "iso8859-5", "mac_roman", "mac_cyrillic", "mac_latin2", "cp437", "cp850", "cp852", "cp932", "euc_jp", "gb18030", "big5", "cp949", "cp1253"]
# ------------------------------------------------------------------------------------
#: Those of them in which every byte is a character.
SINGLE = frozenset(RIGHT) - {"utf-8", "cp932", "euc_jp", "gb18030", "big5", "cp949"}

#: Encodings that make one character of several bytes; those in which such a byte never
#: stands alone.
WIDE = frozenset(["gb18030", "cp932", "euc_jp", "big5", "cp949"])
TAILED = frozenset(["utf-8", "euc_jp"])
#: Those in which it never stands alone before a blank or a mark.
PAIRED = frozenset(["gb18030", "big5", "cp949"])

_FAR = re.compile("[^\x00-\x7f]")
_ALONE = re.compile("(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])")
_CLUSTER = re.compile("[^\x00-\x7f]+")
_DANGLING = re.compile("(?<![^\x00-\x7f])[^\x00-\x7f](?=[\x00-\x2f\x3a-\x3f]|\\Z)")
_NARROW = re.compile("[^\u2e80-\U0010ffff]+")
_LOST = re.compile("\ufffd+")
_C1 = re.compile("[\x80-\x9f]")


def to_bytes(text: str, encoding: str) -> bytes | None:
    """``text`` as the bytes that ``encoding`` would have made it from; bytes that the
    encoding leaves undefined stand as C1 controls, as decoders let them through."""
    try:
        return text.encode(encoding)
    except UnicodeError:
        pass
    if encoding != "latin-1" and encoding not in WIDE and _C1.search(text):
        try:
            return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(encoding) for c in text)
        except UnicodeError:
            return None
    if encoding == "gb18030" and "€" in text:
        try:
            return b"".join(b"\x80" if c == "€" else c.encode("gb18030") for c in text)
        except UnicodeError:
            return None
    return None


def from_bytes(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeError:
        return None


class PairModel:
    """How expected a character is after another one, in this corpus."""

    def __init__(self, chars: dict[int, int], pairs: tuple[np.ndarray, np.ndarray]):
        total = max(1, sum(chars.values()))
        own = sorted(chars, key=lambda c: (-chars[c], c))[:OWN]
        self.code = (OWN + np.arange(0x110000) // BLOCK).astype(np.uint16)
        self.code[own] = np.arange(len(own))
        p_char = np.full(0x110000, LEAST)
        at = np.fromiter(chars, dtype=np.int64, count=len(chars))
        p_char[at] = np.maximum(LEAST, np.fromiter(chars.values(), dtype=np.float64, count=len(chars)) / total)
        in_class = np.zeros(CLASSES)
        np.add.at(in_class, self.code[at], p_char[at])
        in_class = np.maximum(in_class, LEAST)
        self.marginal = np.log(p_char).astype(np.float16)
        self.within = np.log(np.minimum(1.0, p_char / in_class[self.code])).astype(np.float16)
        table = np.zeros(CLASSES * CLASSES, dtype=np.float64)
        table[pairs[0]] = pairs[1]
        table = table.reshape(CLASSES, CLASSES)
        rows = np.maximum(table.sum(axis=1, keepdims=True), 1.0)
        #: Characters that are not too rare to be what a garbled one was.
        self.common = frozenset(map(chr, at[p_char[at] > LEAST].tolist()))
        self.given = np.log(np.maximum((1 - MIXED) * table / rows + MIXED * in_class, LEAST)).astype(np.float16)
        #: The most that a character of a class can score, whatever stands before it.
        self.best = self.given.max(axis=0).astype(np.float32)

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(I(a;b) + ln P(b) of every adjacent pair, code points)."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        k = self.code[c]
        return self.given[k[:-1], k[1:]].astype(np.float32) + self.within[c[1:]], c

    def log_probability(self, text: str) -> float:
        return float(self.scores(text)[0].sum()) if len(text) > 1 else 0.0


def segments(score: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments [i, j) of a sequence of scores (Ruzzo and Tompa)."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    total, i, n = 0.0, 0, len(score)
    while i < n:
        if score[i] <= 0:
            total += score[i]
            i += 1
            continue
        begin, before = i, total
        while i < n and score[i] > 0:
            total += score[i]
            i += 1
        now = (begin, i, before, total)
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= now[2]:
                k -= 1
            if k < 0 or stack[k][3] >= now[3]:
                stack.append(now)
                break
            now = (stack[k][0], now[1], stack[k][2], now[3])
            del stack[k:]
    return [s[:2] for s in stack]


class Restorer:
    def __init__(self, model: PairModel):
        self.model = model
        self.memo: dict[tuple[str, str, str, bool], tuple[str, float] | None] = {}
        self.readings: dict[int, int] = {}
        self.ways: dict[str, int] = {}
        self.reaches: dict[str, np.ndarray] = {}
        self.ways_of: dict[frozenset[str], list[tuple[str, list[str]]]] = {}

    def _ways_of_byte(self, byte: int) -> int:
        """A bit for each of ``RIGHT`` in which a byte can stand: in ``SINGLE`` ones it must
        say a character that is common."""
        got = self.readings.get(byte)
        if got is None:
            got = 0
            for k, right in enumerate(RIGHT):
                said = from_bytes(bytes([byte]), right) if right in SINGLE else ""
                if said is not None and self.model.common.issuperset(said):
                    got |= 1 << k
            self.readings[byte] = got
        return got

    def _ways_of_char(self, c: str) -> int:
        """The mappings that a character can have gone through: for each of ``WRONG`` as many
        bits as ``RIGHT`` has encodings."""
        got = self.ways.get(c)
        if got is None:
            got = 0
            for k, wrong in enumerate(WRONG):
                data = to_bytes(c, wrong)
                # four bytes of gb18030 hold digits between bytes that begin no character elsewhere
                if data is not None and len(data) < 4:
                    ways = (1 << len(RIGHT)) - 1
                    for byte in data:
                        ways &= self._ways_of_byte(byte)
                    if wrong in RIGHT:
                        ways &= ~(1 << RIGHT.index(wrong))
                    got |= ways << k * len(RIGHT)
            self.ways[c] = got
        return got

    def _reach_of_char(self, c: str) -> np.ndarray:
        """By (wrong, right): the most that the character can score that ``c`` was, where both
        encodings are ``SINGLE``; 0 for others."""
        got = self.reaches.get(c)
        if got is None:
            got = self.reaches[c] = np.zeros((len(WRONG), len(RIGHT)), dtype=np.float32)
            for k, wrong in enumerate(WRONG):
                data = to_bytes(c, wrong) if wrong not in WIDE else None
                if data is not None:
                    for j, right in enumerate(RIGHT):
                        said = from_bytes(data, right) if right in SINGLE else None
                        if said:
                            at = ord(said)
                            got[k, j] = self.model.best[self.model.code[at]] + self.model.within[at]
        return got

    def reach(self, run: str) -> np.ndarray:
        """By (wrong, right): the most that the characters beyond ASCII of a reading score."""
        return sum(n * self._reach_of_char(c) for c, n in Counter(_FAR.findall(run)).items())

    def mappings(self, run: str) -> list[tuple[str, list[str]]]:
        """(right, wrongs) of the mappings that none of a run's characters rules out."""
        chars = frozenset(_FAR.findall(run))
        if not chars:
            return []
        got = self.ways_of.get(chars)
        if got is None:
            ways = (1 << len(RIGHT) * len(WRONG)) - 1
            for c in chars:
                ways &= self._ways_of_char(c)
                if not ways:
                    break
            by_right: dict[int, list[str]] = {}
            for wrong in WRONG:
                here, k = ways & (1 << len(RIGHT)) - 1, 0
                ways >>= len(RIGHT)
                while here:
                    if here & 1:
                        by_right.setdefault(k, []).append(wrong)
                    here >>= 1
                    k += 1
            got = [(RIGHT[k], by_right[k]) for k in sorted(by_right)]
            if len(self.ways_of) > 100_000:
                self.ways_of.clear()
            self.ways_of[chars] = got
        return got

    def scored(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray]]:
        """(index, improbable runs, log-probability before each place: of all pairs and of
        those beyond ASCII) of every text that has such runs; a run is (begin, end, total score). Whole lists are scored in one pass."""
        big = "\n".join(["", *texts, ""])
        s, c = self.model.scores(big)
        e = np.minimum(s, self.model.marginal[c[1:]] + LIFT)
        far = (c[:-1] > 127) | (c[1:] > 127)
        e[(c[:-1] == 0xFFFD) | (c[1:] == 0xFFFD)] = NEVER  # what stands for lost bytes is expected nowhere
        rare = np.flatnonzero(far & (e < RARE))
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        score = np.where(far, np.clip(EXPECTED - e, -ORDINARY, 6.0), -ORDINARY)
        before = np.zeros((len(s) + 1, 2))
        np.cumsum(s, dtype=np.float64, out=before[1:, 0])
        np.cumsum(s * far, dtype=np.float64, out=before[1:, 1])
        for k_ in np.unique(np.searchsorted(begins, rare, "right") - 1).tolist():
            if 0 <= k_ < len(texts) and len(texts[k_]) > 1:
                at, n = int(begins[k_]), len(texts[k_])
                mine = rare[np.searchsorted(rare, at) : np.searchsorted(rare, at + n - 1)] - at
                if len(mine):
                    here = score[at : at + n - 1]
                    total = np.zeros(n)
                    np.cumsum(here, out=total[1:])
                    # no segment goes on over a new least total: what lies between two is done alone
                    least = np.flatnonzero(total == np.minimum.accumulate(total))
                    block = np.unique(np.searchsorted(least, mine, "right"))
                    least, mine, runs = [*least.tolist(), n - 1], mine.tolist(), []
                    for b in block.tolist():
                        a = least[b - 1]
                        for i, j in segments(here[a : least[b]].tolist()):
                            # a line feed is never garbled, so what stands before it tells nothing of what follows
                            i, j = a + i, a + j
                            while i < j:
                                k = texts[k_].find("\n", i, j + 1)
                                k = j + 1 if k < 0 else k  # the part's characters are i to k
                                if k > i and bisect_left(mine, min(k, j)) > bisect_left(mine, max(i - 1, 0)):
                                    runs.append((i, k, float(total[min(k, j)] - total[i])))
                                i = k + 1
                    yield k_, runs, before[at - 1 : at + n + 1]

    def improbable(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, total score) of the improbable runs of one text."""
        return next((runs for _, runs, _ in self.scored([text])), [])

    def inverse(self, before: str, run: str, after: str, only_utf8: bool = False, was: tuple[float, float] | None = None) -> tuple[str, float] | None:
        """The best reading of ``run`` between two characters, and its gain; ``was`` is the
        log-probability of all of it, and of its pairs beyond ASCII."""
        key = (before, run, after, only_utf8)
        if key in self.memo:
            return self.memo[key]
        mappings = self.mappings(run)
        if not mappings or only_utf8 and mappings[0][0] != "utf-8":
            return None
        best: tuple[str, float] | None = None
        if was is None:
            pairs, c = self.model.scores(before + run + after)
            was = float(pairs.sum()), float(pairs[(c[:-1] > 127) | (c[1:] > 127)].sum())
        was, was_far = was
        room = -was - BEST_CHAR * (len(run) // 3)  # no reading gains more
        if room >= MARGIN_UTF8:
            common, n = self.model.common, len(run)
            tried: set[str] = {run}
            others = not only_utf8 and -was - BEST_CHAR * n >= MARGIN_OTHER
            bounds, bytes_of = None, {}
            alone, dangling = bool(_ALONE.search(run)), bool(_DANGLING.search(run))
            for right, wrongs in mappings:
                if right != "utf-8" and (best or not others):
                    break  # valid UTF-8 that fits is seldom an accident
                if right in SINGLE:
                    if bounds is None:  # what these change are pairs beyond ASCII only
                        bounds = self.reach(run) - was_far + 0.01 * n
                    j = RIGHT.index(right)
                    wrongs = [w for w in wrongs if w in WIDE or bounds[WRONG.index(w), j] >= MARGIN_OTHER]
                broken = alone and right in TAILED or dangling and right in PAIRED
                for wrong in wrongs:
                    if broken and wrong not in WIDE:
                        continue  # a byte from U+0080 on that stands so is no character there
                    if wrong not in bytes_of:
                        bytes_of[wrong] = to_bytes(run, wrong)
                    d = bytes_of[wrong]
                    said = from_bytes(d, right) if d is not None else None
                    if said is None or said in tried:
                        continue
                    tried.add(said)
                    if not common.issuperset(said) and not (right == "utf-8" and self.again(said)):
                        continue
                    gain = self.model.log_probability(before + said + after) - was
                    if right == "utf-8":
                        ok = gain >= MARGIN_UTF8
                    else:
                        changed = sum(x != y for x, y in zip(run, said)) if n == len(said) else max(n, len(said))
                        ok = gain >= MARGIN_OTHER and gain >= MARGIN_CHAR * changed
                    if ok and (best is None or gain > best[1]):
                        best = (said, gain)
        if len(self.memo) > 50_000:
            self.memo.clear()
        if len(run) <= 2 * STRETCH:
            self.memo[key] = best
        return best

    def again(self, said: str) -> bool:
        """Whether a reading has rare characters because it is itself garbled."""
        return any((d := to_bytes(said, w)) is not None and from_bytes(d, "utf-8") is not None for w in WRONG[:8])

    def _spans(self, text: str, a: int, z: int, score: float, floor: int = 0) -> list[tuple[int, int]]:
        """The run, its non-ASCII core, its words and, if much speaks for it, its line
        and, of a long one, the stretches around it; these begin at ``floor`` at least."""
        out = [(a, z)]
        i, j = a, z
        while i < j and text[i] < "\x80":
            i += 1
        while j > i and text[j - 1] < "\x80":
            j -= 1
        while i > 0 and text[i - 1] >= "\x80":
            i -= 1
        while j < len(text) and text[j] >= "\x80":
            j += 1
        out.append((i, j))
        i, j = a, z
        while i > 0 and not text[i - 1].isspace() and a - i < STRETCH:
            i -= 1
        while j < len(text) and not text[j].isspace() and j - z < STRETCH:
            j += 1
        out.append((i, j))
        if score >= LINE_SCORE:
            i, j = text.rfind("\n", 0, a) + 1, text.find("\n", z)
            j = len(text) if j < 0 else j
            out.append((max(i, floor) if j - i > STRETCH else i, j))
            if j - i > STRETCH:
                half, k = STRETCH // 2, (a - i) // (STRETCH // 2)
                for b in (i + (k - 1) * half, i + k * half):
                    e = b + STRETCH
                    blank = text.rfind(" ", max(i, b - TO_BLANK), b) if b > i else i - 1
                    b = max(i, blank + 1 if blank >= 0 else b)
                    blank = text.find(" ", e, min(j, e + TO_BLANK)) if e < j else j
                    out.append((max(b, floor), min(j, blank if blank >= 0 else e)))
        return list(dict.fromkeys(out))

    def once(self, text: str, runs: list[tuple[int, int, float]], before: np.ndarray) -> tuple[str, int]:
        """Every improbable run read anew where that is better; how many were."""
        out, at, n = [], 0, 0
        of_line: dict[int, float] = {}
        vain: set[tuple[int, int]] = set()  # long spans that have no better reading
        for a, _, score in runs:
            line = text.rfind("\n", 0, a)
            of_line[line] = of_line.get(line, 0.0) + score
        for a, z, _ in runs:
            score = of_line[text.rfind("\n", 0, a)]
            a = max(a, at)
            if z <= a:
                continue
            best = None
            for i, j in self._spans(text, a, z, score, at):
                if i < at or j <= i or (i, j) in vain:
                    continue
                got = self.inverse(text[i - 1 : i] if i else "\n", text[i:j], text[j : j + 1] or "\n", was=tuple((before[j + 1] - before[i]).tolist()))
                if not got and j - i > STRETCH // 2:
                    vain.add((i, j))
                if got and (best is None or got[1] > best[3] + 1.0):
                    best = (i, j, got[0], got[1])
            found = [best] if best else []
            if not best:  # its parts before, between and after characters of other scripts each
                end = at
                lo, hi = max(at, text.rfind("\n", 0, a) + 1, a - STRETCH), text.find("\n", z)
                hi = min(len(text) if hi < 0 else hi, z + STRETCH)
                for m in _NARROW.finditer(text, lo, hi):
                    i, j = m.span()
                    if i < z and j > a and (i > lo or j < hi):
                        far = [k for k in range(i, j) if text[k] > "\x7f"]
                        i, j = (max(far[0], end), far[-1] + 1) if len(far) > 1 else (0, 0)
                        for j in (j, j + 1):  # the last character may end in a letter
                            got = self.inverse(text[i - 1 : i] if i else "\n", text[i:j], text[j : j + 1] or "\n") if i < j <= hi else None
                            if got:
                                found.append((i, j, got[0], got[1]))
                                end = j
                                break
            if not found:  # its clusters each; a no-break space may have become a space
                i = a
                while i > at and text[i - 1] >= "\x80":
                    i -= 1
                for m in _CLUSTER.finditer(text, i, z + 1):
                    i, j = m.span()
                    left = text[i - 1 : i] if i else "\n"
                    got = self.inverse(left, m.group(), text[j : j + 1] or "\n", True)
                    if not got and text[j : j + 1] == " ":
                        got = self.inverse(left, m.group() + "\xa0", text[j + 1 : j + 2] or "\n", True)
                        j += bool(got)
                    if got:
                        found.append((i, j, got[0], got[1]))
            for i, j, said, _ in found:
                out += [text[at:i], said]
                at = j
                n += 1
        return "".join([*out, text[at:]]) if n else text, n

    def restore(self, text: str) -> tuple[str, int, int]:
        """(restored text, passages restored, passages that can't be)."""
        return next((got for _, got in self.restore_all([text])), (text, 0, 0))

    def restore_all(self, texts: list[str | None]) -> Iterator[tuple[int, tuple[str, int, int]]]:
        """(index, what ``restore`` says) of every affected text, in order. What was changed
        is read again until nothing changes, for text that was garbled more than once."""
        who = [k for k, t in enumerate(texts) if t and not t.isascii()]
        now: dict[int, str] = {}
        passages: dict[int, int] = {}
        lost: dict[int, int] = {}
        for at in range(0, len(who), 256):
            todo = who[at : at + 256]
            seen: dict[int, set[str]] = {}
            while todo:
                given, again = [now.get(k, texts[k]) for k in todo], []
                for i, runs, before in self.scored(given):
                    k = todo[i]
                    new, n = self.once(given[i], runs, before)
                    lost[k] = 0 if n else self.lost(given[i], runs)
                    if n:
                        now[k] = new
                        passages[k] = max(passages.get(k, 0), n)
                        if new not in seen.setdefault(k, {given[i]}):
                            seen[k].add(new)
                            again.append(k)
                todo = again
        for k in sorted({*passages, *(k for k, n in lost.items() if n)}):
            yield k, (now.get(k, texts[k]), passages.get(k, 0), lost.get(k, 0))

    @staticmethod
    def lost(text: str, runs: list[tuple[int, int, float]]) -> int:
        """Passages of improbable runs whose characters are gone: replacement characters at a
        letter, in a row, or more than one."""
        at = {m.span() for a, z, _ in runs for m in _LOST.finditer(text, a, z)}
        n = sum(1 for a, z in at if z - a > 1 or text[max(0, a - 1) : a].isalpha() or text[z : z + 1].isalpha())
        return n if n or len(at) < 2 else 1


def _count_chars(docs: DataFrame, text: str) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = "\n".join(t for t in b.column(0).to_pylist() if t)
            c, n = np.unique(np.frombuffer(all_.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], ["c", "n"])

    return docs.select(text).mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))


def pair_model(docs: DataFrame, text: str = "text") -> PairModel:
    """Learnt from every character and every adjacent pair of all texts. What reaches the
    driver has at most 0x110000 and CLASSES^2 rows."""
    import pyarrow as pa

    chars = {r.c: r.n for r in _count_chars(docs, text).collect()}
    code = PairModel(chars, (np.zeros(0, dtype=np.int64), np.zeros(0))).code
    sent = docs.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value
        for b in batches:
            parts = []
            for t in b.column(0).to_pylist():
                if t and len(t) > 1:
                    k = code[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.int64)
                    parts.append(k[:-1] * CLASSES + k[1:])
            p, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], ["p", "n"])

    counted = docs.select(text).mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    return PairModel(chars, (table.column("p").to_numpy(), table.column("n").to_numpy().astype(np.float64)))


#: This Python worker's restorer.
_RESTORERS: list[Restorer] = []


def restore_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored_text, passages, lost) of each affected document: how many passages
    were restored, and how many are garbled but can't be.

    Null, empty and blank texts are not affected; repeated rows come out as often as they
    come in; a null key stays null; texts of any length are read whole; an empty table
    gives an empty one; other columns are not read. Correct text in any language, rare
    symbols, escapes and entities are left alone.
    """
    import pyarrow as pa

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    model = pair_model(rows, "t")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _RESTORERS or _RESTORERS[0].model is not sent.value:
            _RESTORERS[:] = [Restorer(sent.value)]
        restorer = _RESTORERS[0]
        for b in batches:
            out = [(at, clean(new), passages, lost) for at, (new, passages, lost) in restorer.restore_all(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int32())], ["k", "restored_text", "passages", "lost"])

    return rows.where("t is not null").mapInArrow(run, f"k {kind}, restored_text string, passages int, lost int").withColumnRenamed("k", key)


def garbled_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of the affected documents."""
    return restore_texts(docs, key, text).select(key)
