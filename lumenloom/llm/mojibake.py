"""Problem 10: text read in another encoding than it was written in, by a hidden Markov model.

There is one clean state and one state per encoding pair (written as, read as). A state's units are the
character sequences that stand for one original character: one character in the clean state and for
pairs of single-byte encodings, up to nine for UTF-8 garbled twice. A unit costs what its original
character costs in clean text after its neighbour: character classes follow each other, characters are
drawn within a class; both come from samples of clean text. Entering a garbled state costs
``ENTER``, leaving it ``LEAVE``. The best path labels every character; each labelled span is restored by
its state's inverse transform. U+FFFD is what a failed reading leaves: it marks a text, and can't be undone.

A text goes through the model with the states that it holds a possible trace of (none for most texts),
and with its non-ASCII characters only, as ASCII looks the same in every state; words of ASCII letters
speak against states whose originals are Cyrillic or Chinese.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log
from unicodedata import decomposition

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs (nats) of entering and leaving a garbled state, of an ASCII word in a state of another script, and of
#: entering one behind a clean letter of the same run.
ENTER, LEAVE, FOREIGN_WORD, ENTER_INSIDE = 5.0, 1.5, 1.5, 4.0
TYPOGRAPHIC = "’‘“”„…–—•€«»\xa0"
SYMBOLS = "‚·£¥¢§©®™°±×÷½¼¾µ¬№→←↑↓≥≤≈‹›¡¿ªº²³¹†‡ﬁﬂ①②③④⑤"
MARKS = frozenset(TYPOGRAPHIC.replace("’", "") + SYMBOLS)
HAN_MARKS = "，。、：；！？（）“”《》「」『』　"

#: What the bytes 0x81, 0x8d, 0x8f, 0x90 and 0x9d, which Windows-1252 leaves out, are read as.
_LENIENT = {"cp1252": {b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}}
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850")
SINGLE_BYTE = (
    ("cp1251", "cp1252"),
    ("koi8-r", "cp1251"),
    ("cp1251", "koi8-r"),
    ("koi8-r", "cp1252"),
    ("cp866", "cp1251"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "mac-roman"),
    ("mac-roman", "cp1252"),
    ("cp850", "cp1252"),
    ("cp1252", "cp1251"),
)
OTHER_SCRIPT = {"cp1251", "koi8-r", "cp866", "gbk"}


def _bytes_of(encoding: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = _LENIENT.get(encoding, {}).get(b)
        if c and c != "�":
            out[c] = b
    return out


def kind(c: str) -> str:
    """The class of a character: A ASCII letter, D digit, N other ASCII, L accented Latin, Y Russian, H Chinese,
    P typographic, S symbol, Z Chinese mark, G Greek, B box drawing, C control, O other."""
    o = ord(c)
    if o < 128:
        return "A" if c.isalpha() else "D" if c.isdigit() else "N"
    if 0x410 <= o <= 0x44F or c in "ёЁ":
        return "Y"
    if 0x4E00 <= o <= 0x9FFF:
        return "H"
    if c in TYPOGRAPHIC:
        return "P"
    if c in SYMBOLS:
        return "S"
    if c in HAN_MARKS:
        return "Z"
    if 0xC0 <= o <= 0x17F:
        return "L"
    if 0x370 <= o <= 0x3FF:
        return "G"
    if 0x2500 <= o <= 0x259F:
        return "B"
    return "C" if o < 0xA0 else "O"


#: How likely a class is after a class; what isn't named has probability RARE.
FOLLOWS = {
    "N": {"L": 0.05, "Y": 0.1, "H": 0.1, "P": 0.05, "S": 0.03, "Z": 0.01, "G": 3e-4, "B": 3e-3, "O": 3e-3},
    "D": {"L": 0.005, "Y": 0.01, "H": 0.1, "P": 0.05, "S": 0.03, "Z": 0.01, "G": 1e-5, "B": 1e-5, "O": 1e-4},
    "A": {"L": 0.03, "P": 0.02, "S": 0.004, "Y": 2e-4, "H": 1e-4, "Z": 1e-4, "G": 3e-6, "O": 1e-4, "B": 1e-6},
    "L": {"L": 0.03, "P": 0.05, "S": 0.005, "Y": 1e-5, "H": 1e-5, "O": 1e-4},
    "Y": {"Y": 0.85, "P": 0.05, "S": 0.005, "L": 1e-5, "O": 1e-4},
    "H": {"H": 0.8, "Z": 0.1, "P": 0.01, "S": 0.002, "N": 0.01, "O": 1e-4},
    "P": {"P": 0.05, "S": 0.02, "L": 0.03, "Y": 0.05, "H": 0.05, "Z": 0.02, "G": 3e-4, "B": 1e-4, "O": 1e-3},
    "S": {"S": 0.05, "P": 0.03, "L": 0.01, "Y": 0.02, "H": 0.02, "Z": 0.01, "G": 3e-4, "B": 1e-4, "O": 1e-3},
    "Z": {"H": 0.8, "Z": 0.1, "P": 0.05, "S": 0.01, "Y": 1e-3, "L": 1e-3, "O": 1e-3},
    "G": {"G": 0.6, "P": 0.02, "S": 0.01, "L": 0.01},
    "B": {"B": 0.8, "P": 1e-4, "L": 1e-4, "Y": 1e-3, "H": 1e-3},
    "O": {"O": 0.7, "P": 0.02, "S": 0.01, "Z": 0.01, "H": 0.02, "Y": 0.05, "L": 0.02},
    "C": {"C": 0.01, "P": 0.01, "S": 0.01, "L": 0.01},
}
RARE = 1e-6
#: Costs (nats) of a capital behind a small letter, of a small letter before an ASCII capital, of an accented
#: letter standing alone that does so in no sample, and of a restored mark (but an apostrophe) inside a word.
CAPITAL_INSIDE, CAPITAL_BEHIND, ALONE, MARK_INSIDE = 5.0, 3.0, 3.0, 5.0
#: Probability of a character that the samples don't hold, within its class.
UNSEEN = {"L": 1e-3, "Y": 1e-3, "H": 2e-6, "P": 1 / 30, "S": 1 / 60, "Z": 1 / 30, "G": 1 / 40, "B": 1 / 40, "C": 1 / 40, "O": 2e-5}


class Clean:
    """Costs of characters in clean text, from samples in the languages of the collection."""

    def __init__(self, samples: list[str]):
        self.counts: dict[str, Counter] = {}
        self.pairs, self.firsts, self.alone = Counter(), Counter(), Counter()
        for text in samples:
            before = " "
            self.alone.update(m.group() for m in _ALONE.finditer(text))
            for c in text:
                k = kind(c)
                self.counts.setdefault(k, Counter())[c] += 1
                if k == "Y":
                    if kind(before) == "Y":
                        self.pairs[before, c] += 1
                        self.firsts[before] += 1
                before = c
        self.totals = {k: sum(n.values()) for k, n in self.counts.items()}
        self.memory: dict[tuple[str, str], float] = {}

    def within(self, c: str, k: str) -> float:
        n = self.counts.get(k, {}).get(c, 0) if k in "LYH" else 0
        if n:
            return n / (self.totals[k] + 50)
        if k == "L" and c.isupper() and (n := self.counts.get(k, {}).get(c.lower(), 0)):
            return n / (self.totals[k] + 50) / 10
        if k == "L" and ord(c) > 0xFF and c not in "œŒ":
            return UNSEEN["L"] / 20
        return UNSEEN.get(k, RARE)

    def cost(self, before: str, c: str) -> float:
        """-ln P(c | the character before it)."""
        key = (before if kind(before) == "Y" else kind(before) + "a" * before.islower(), c)
        found = self.memory.get(key)
        if found is None:
            k = kind(c)
            if k in "AND":
                found = 0.0
            elif k == "Y" and kind(before) == "Y":
                share = (self.pairs[before, c] + 40 * 0.25 * self.within(c, k)) / (self.firsts[before] + 40)
                found = -log(FOLLOWS["Y"]["Y"] * max(share, 1e-5))
            else:
                found = -log(FOLLOWS[kind(before)].get(k, RARE) * self.within(c, k))
                if k == "L" and c.isupper() and before.islower():
                    found += CAPITAL_INSIDE
            self.memory[key] = found
        return found


    def standing(self, before: str, run: str, behind: str) -> float:
        """What a clean run of non-ASCII characters costs more for its neighbours."""
        last = run[-1]
        if kind(last) != "L":
            return 0.0
        if last.islower() and "A" <= behind <= "Z":
            return CAPITAL_BEHIND
        alone = len(run) == 1 and not before.isalpha() and not behind.isalpha()
        return ALONE if alone and not self.alone[last] and decomposition(last) else 0.0


_ALONE = re.compile(r"(?<!\w)[À-ſ](?!\w)")


class State:
    """A garbled state: from the characters at a place to its units (length, original)."""

    def __init__(self, written: str, read: str, times: int = 1):
        self.written, self.read, self.times = written, read, times
        self.name = f"{written}>{read}" + ">again" * (times - 1)
        self.foreign = written in OTHER_SCRIPT
        self.byte = {} if read == "gbk" else _bytes_of(read)
        self.units = lru_cache(maxsize=100_000)(self._units)
        self.trace = self._trace()

    def _trace(self):
        """Matches the pieces (non-ASCII runs with their neighbour letters) in which this state may win."""
        if self.read == "gbk":
            return _reads_as_utf8
        if self.written == "utf-8":
            back = {b: c for c, b in self.byte.items()}
            some = lambda lo, hi: _class("".join(back[b] for b in range(lo, hi + 1) if b in back))
            tail = some(0x80, 0xBF)
            return re.compile("|".join([some(0xC2, 0xDF) + tail, some(0xE0, 0xEF) + tail + "{2}", some(0xF0, 0xF4) + tail + "{3}"])).search
        if self.foreign and self.read in ("cp1252", "latin-1"):
            return re.compile("[\xa1-\xff]{3}").search
        odd = _class("".join(c for c in self.byte if kind(c) in "GBOS" and c not in _USUAL or kind(c) == "L" and c not in _USUAL))
        if self.foreign:  # one Cyrillic encoding read as another: capitals or signs in the wrong place
            return re.compile("[а-яё][А-ЯЁ]|" + odd + "[А-Яа-яЁё]|[А-Яа-яЁё]" + odd).search
        wrong = "|[A-Za-z]" + _class("ÁÈËÍÌÎÏÓÔÒÚÛÙ‡†·‚„") + "[a-z]|[a-z]" + _class("ÈËÍÁ‡‚ŠŽ") + "|^[‡‚„†Šˆ‰][a-z]|^[ÈÍÎÏËÔ][a-z]"
        cyrillic = "|[a-z][А-Яа-яЁё]|[А-Яа-яЁё][a-z]" if self.read == "cp1251" else ""
        # letters that would be marks: before a capital, alone, or where an English apostrophe stands
        as_marks = {c for c, b in self.byte.items() if kind(c) == "L" and kind(bytes([b]).decode(self.written, "replace")) in "PS"}
        if as_marks:
            lonely = as_marks - set("àéóôÀÉÓÔ")  # those are words by themselves
            wrong += f"|^{_class(as_marks)}[A-Z]" + (f"|^{_class(lonely)}$" if lonely else "")
        apostrophes = [c for c, b in self.byte.items() if c != "’" and bytes([b]).decode(self.written, "replace") == "’"]
        if apostrophes:
            wrong += f"|[tyeIun]{_class(apostrophes)}[stmdlrv]$"
        drawn = [c for c in self.byte if kind(c) in "BO"]
        if drawn:
            wrong += f"|^{_class(drawn)}$"
        return re.compile(odd + "[^\\W\\d_]|[^\\W\\d_]" + odd + wrong + cyrillic).search

    def _raw(self, piece: str) -> bytes | None:
        if self.read == "gbk":
            try:
                return piece.encode("gbk")
            except UnicodeEncodeError:
                return None
        out = bytearray()
        for c in piece:
            b = self.byte.get(c)
            if b is None:
                if ord(c) < 128:
                    b = ord(c)
                else:
                    return None
            out.append(b)
        return bytes(out)

    def _undo(self, piece: str) -> str | None:
        for _ in range(self.times):
            raw = self._raw(piece)
            if raw is None:
                return None
            try:
                piece = raw.decode(self.written)
            except UnicodeDecodeError:
                return None
        return piece

    def _units(self, ahead: str) -> tuple[tuple[int, str], ...]:
        """Units that begin ``ahead`` (a run of non-ASCII characters)."""
        out = []
        if self.read != "gbk" and ahead[0] not in self.byte:
            return ()
        longest = {"utf-8": 4 if self.times == 1 else 9, "gbk": 2}.get(self.written, 1)
        if self.read == "gbk":
            longest = 3
        for n in range(1 if longest == 1 or self.read == "gbk" else 2, min(longest, len(ahead)) + 1):
            original = self._undo(ahead[:n])
            if original and original != ahead[:n] and len(original) < max(n, 2) and not any(c < " " or "\x7f" <= c <= "\x9f" or "\ud800" <= c <= "\uf8ff" or c == "�" for c in original):
                out.append((n, original))
        return tuple(out)


def states() -> list[State]:
    found = [State("utf-8", read) for read in UTF8_READ_AS]
    found += [State("utf-8", "cp1252", 2), State("utf-8", "latin-1", 2), State("utf-8", "gbk"), State("gbk", "latin-1"), State("gbk", "cp1252")]
    return found + [State(w, r) for w, r in SINGLE_BYTE]


def _class(chars: str) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]"


_USUAL = set(TYPOGRAPHIC + SYMBOLS) - set("†‡‚·ﬁﬂ") | set("áàâãäåæçéèêëíìîïñóòôõöøúùûüýÿßœŒÁÀÂÃÄÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÕÖØÚÙÛÜÝÞþðÐ")
_HAN = re.compile("[一-鿿ㄅ-ㄩぁ-ヿ㈠-㈩╂-╋\ue000-\uf8ff，。]{2,}")


def _reads_as_utf8(piece: str) -> bool:
    """Whether a run of Chinese characters, as GBK bytes, is UTF-8 throughout, or for the greater part, or a
    Chinese character beside an ASCII letter is an accented one."""
    if len(piece) < 6 and (piece[0].isascii() or piece[-1].isascii()):
        for c in piece:
            if kind(c) == "H" and c.encode("gbk", "ignore").decode("utf-8", "ignore"):
                return True
    for m in _HAN.finditer(piece):
        run = m.group()
        read = run.encode("gbk", "ignore").decode("utf-8", "ignore")
        # three GBK characters stand for two; where some were lost, U+FFFD stands nearby
        if (0.45 if "�" in piece else 0.6) * len(run) < len(read) < len(run):
            return True
    return False


class Suspects:
    """Which states a text gives reason to consider; verdicts on its non-ASCII pieces are remembered."""

    def __init__(self, all_states: list[State], remembered: int = 200_000):
        self.states, self.remembered, self.memory = all_states, remembered, {}

    def verdict(self, piece: str) -> int:
        mask = self.memory.get(piece)
        if mask is None:
            mask = sum(1 << i for i, s in enumerate(self.states) if s.trace(piece))
            if len(self.memory) > self.remembered:
                self.memory.clear()
            self.memory[piece] = mask
        return mask

    def active(self, text: str) -> list[State]:
        if text.isascii():
            return []
        mask = 0
        for piece in set(_PIECE.findall(text)):
            mask |= self.verdict(piece)
        return [s for i, s in enumerate(self.states) if mask >> i & 1]


_PIECE = re.compile("[A-Za-z]?[^\x00-\x7f]+[A-Za-z]?")
_WORD = re.compile("[A-Za-z]{2,}")


def label(text: str, clean: Clean, active: list[State]) -> list[tuple[int, int, str, str]]:
    """(start, end, state, original) of the garbled units of a text on the best path."""
    if not active:
        return []
    runs = [(m.start(), m.group()) for m in re.finditer(r"[^\x00-\x7f]+", text)]
    size = len(active) + 1
    far = float("inf")
    best = [0.0] + [ENTER] * (size - 1)  # cost so far, by state; 0 is clean
    back: list[list] = []  # steps of the runs, last first when followed
    position = 0
    for start, run in runs:
        words = len(_WORD.findall(text, position, start)) if position else 0
        if words:
            best = [b + (FOREIGN_WORD * min(words, 20) if k and active[k - 1].foreign else 0.0) for k, b in enumerate(best)]
        before = text[start - 1] if start else " "
        behind = text[start + len(run) : start + len(run) + 1]
        standing = clean.standing(before, run, behind)
        table = [best] + [[far] * size for _ in run]
        came: list[list] = [[None] * size for _ in range(len(run) + 1)]
        for i in range(len(run)):
            row = table[i]
            # switch first: to clean from any state, to any state from clean
            low = min(range(size), key=row.__getitem__)
            entry = ENTER + (ENTER_INSIDE if i and not low and run[i - 1].isalpha() else 0.0)
            settled = []
            for k in range(size):
                direct = row[k]
                change = row[low] + (LEAVE if low else 0.0) + (entry if k else 0.0) if low != k else far
                settled.append((direct, k) if direct <= change else (change, low))
            previous = run[i - 1] if i else before
            step = settled[0][0] + clean.cost(previous, run[i]) + (standing if i == len(run) - 1 else 0.0)
            if step < table[i + 1][0]:
                table[i + 1][0], came[i + 1][0] = step, (i, settled[0][1], None)
            for k, state in enumerate(active, 1):
                cost, origin = settled[k]
                for n, original in state.units(run[i : i + 9]):
                    neighbour = before if not i else original[0] if kind(original[0]) in "YHLGO" else "e"
                    step = cost + clean.cost(neighbour if not (i and kind(original[0]) == "L") else "é", original[0]) + sum(clean.cost(a, b) for a, b in zip(original, original[1:], strict=False))
                    if i and kind(original[0]) == "Y" and came[i][k] and came[i][k][2]:
                        step = cost + clean.cost(came[i][k][2][-1], original[0])
                    if original in MARKS and (i or before.isalpha()) and (i + n < len(run) or behind.isalpha()):
                        step += MARK_INSIDE
                    if step < table[i + n][k]:
                        table[i + n][k], came[i + n][k] = step, (i, origin, original)
        back.append((start, run, came))
        best = table[len(run)]
        position = start + len(run)
        low = min(best)
        best = [min(b, low + (LEAVE if j == 0 else LEAVE + ENTER)) if b == far else b for j, b in enumerate(best)]
    # follow the best path back
    out: list[tuple[int, int, str, str]] = []
    state = min(range(size), key=lambda k: best[k] + (LEAVE if k else 0.0))
    for start, run, came in reversed(back):
        i = len(run)
        if came[i][state] is None:  # the state could not hold this run's end: it was entered after it
            ends = [k for k in range(size) if came[i][k] is not None]
            state = 0 if 0 in ends else ends[0]
        while i:
            if came[i][state] is None:
                state = 0
                if came[i][0] is None:
                    break
            at, origin, original = came[i][state]
            if state:
                out.append((start + at, start + i, active[state - 1].name, original))
            i, state = at, origin
    return out[::-1]


def restore(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, original in spans:
        out += [text[at:start], original]
        at = end
    return "".join(out) + text[at:]


def repair(documents: DataFrame, id_col: str, text_col: str, samples: list[str]) -> DataFrame:
    """``(id, restored, states, spans, lost)`` of the texts that hold garbled characters.

    ``restored`` is the text with every labelled span put right; characters lost for good (U+FFFD) stay,
    ``lost`` counts them. ``states`` names the encoding pairs (written>read), ``spans`` the garbled
    characters' count. Null, empty and clean texts give no row; repeated rows give a row each; texts of
    any length are read whole; an empty table gives no rows. Other columns are not read.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    shape = f"id {id_type}, restored string, states string, spans int, lost int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, suspects = Clean(samples), Suspects(states())
        for batch in batches:
            keep, restored, names, spans, lost = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = label(text, clean, suspects.active(text)) if text else []
                gone = text.count("�") if text else 0
                if found or gone:
                    keep.append(i)
                    restored.append(restore(text, found))
                    names.append(",".join(sorted({f[2] for f in found})))
                    spans.append(len(found))
                    lost.append(gone)
            ids = batch.column(0).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(restored, pa.string()), pa.array(names, pa.string()), pa.array(spans, pa.int32()), pa.array(lost, pa.int32())], names=["id", "restored", "states", "spans", "lost"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, shape)
