"""Sentence boundaries across languages and scripts (problem 9).

Method: boundary rules compiled into a finite transducer, run over chunks as functions of the state.

1. **Alphabet.** A text is read as symbols: marks, quotes, brackets, paragraph breaks, blanks between Thai
   words, and FILL for what lies between. A mark's symbol is looked up in a table compiled from ``RULES``:
   class of the word before it (a trie of abbreviations), class of what follows it. Both are local.
2. **Transducer.** Its states are products of where the reading stands (in a quotation that opened the
   sentence, in one that came later, in a bracket, ...), whether low quotes are open, whether anything was
   said since the last symbol, and whether a final mark was the last thing said. Tables give the next
   state and whether the symbol ends a sentence (:func:`compile_tables`).
3. **Chunks.** Every run of symbols is a function from states to states. Functions of chunks are composed
   by a parallel prefix scan, and each chunk is then replayed from its own start state. Within a task
   chunks are runs of ``CHUNK`` symbols; a document longer than ``LONG`` characters is also cut into pieces
   that go to different tasks, and their functions are composed per document. Pieces are cut only
   where no rule looks across: before a paragraph, between plain words, inside a run of Han or kana.

Rules look at scripts, not at the language a document claims, as that may be missing or wrong.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut

# --- fixed values: abbreviations by what may follow them ------------------------------------------
#: Never end a sentence.
NEVER = frozenset(
    """
    dr prof mr mrs ms messrs mme mlle mm gen lt col sgt capt cpl maj cmdr adm rev hon gov sen rep pres st ste mt ft ave rd blvd
    vol vols pp p pg ch chap sec sect art arts par fig figs eq nr no nos num vs v cf viz incl approx est ca circa e.g i.e eg ie
    vgl bzw z.b d.h u.a u.u o.ä i.d.r s.o s.u str abs hrsg bd jh jhd mio mrd tel ev evtl ggf gem inkl exkl zzgl abzgl max min
    env av apr boul bd éd ed eds réf tél
    ee sr sra srta dra d dña avda pág págs aprox núm ej lic ing arq gral
    βλ σελ κ κα κκ αρ δρ καθ π.χ δηλ λ.χ
    डॉ प्रो क्र श्रीमती पं सं
    د أ م ص
    ดร นพ
    """.split()
)
#: Months: end a sentence before a capital or an opening mark, not before a number.
MONTHS = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec".split())
#: End a sentence before a capital, a number or an opening mark.
SOMETIMES = frozenset("inc ltd co corp bros jr ph.d m.d b.a m.a plc llc e.v gmbh s.a cía".split())
#: End a sentence before any capital, number or opening mark.
OFTEN = frozenset("etc al usw usf a.m p.m π.μ μ.μ a.c d.c".split())
#: Countries: end a sentence before a capital, except before what they usually qualify.
COUNTRIES = frozenset("u.s u.k u.n e.u u.s.a uu ee.uu".split())
QUALIFIED = frozenset(
    """
    navy army senate congress government president house department air supreme open treasury embassy marine marines coast
    secretary attorney state capitol federal military dollar bank security national foreign parliament office home
    """.split()
)

TERMINAL = ".!?…。！？।॥؟｡︒"
STRONG = "。！？।॥؟｡︒"
CLOSERS = "”’»)]}」』》〉】）］"
OPENERS = "“„«‘‚([{「『《〈【（［¿¡"
_TAG = r"</?[a-zA-Z][^<>]*>"
_SKIP = re.compile(rf"(?:\s|[­​-‏⁠﻿̀-ͯ]|{_TAG})*")
#: Every character that can matter, as one set: the scan skips all others at full speed.
_CANDIDATE = re.compile("[" + re.escape(TERMINAL + CLOSERS + OPENERS.replace("¿¡", "") + "’\"';\n") + "]")
_GAP = re.compile(rf"(?:\s|[­​-‏⁠﻿\"'{re.escape(CLOSERS)}]|{_TAG})*")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
_LIST_LINE = re.compile(r"\n[^\S\n]*[-•*·▪◦‣][^\S\n]")
_CLOCK_LINE = re.compile(r"\n[^\S\n]*\d{1,2}[.:]\d\d(?:[ ][A-Z]{2,5})?[^\S\n]*(?:\n|$)")
_THAI = re.compile(r"(?<=[ก-๏])\s+(?=[ก-๏])")
_DATELINE = re.compile(r"(?<![^\n])[^\S\n]*[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’ .\-]{2,40}(?:,[^—–\n(]{0,30})?(?:\s*\([^)\n]{1,30}\))?\s*[—–]\s")
_CLOCK = re.compile(r"(?<![^\n])[^\S\n]*\d{1,2}[.:]\d\d(?: [A-Z]{2,5})?[^\S\n]*(?=\n)")
#: Words before the number of a day or another ordinal ("am 7. Mai"), in small letters or opening a sentence.
BEFORE_ORDINAL = frozenset(w for x in "am im vom zum dem den der die das des beim bis ab seit".split() for w in (x, x.capitalize()))
#: Words that open a sentence with an hour ("At 8 p.m. the ...").
BEFORE_HOUR = frozenset("At By Around About Until From Before After Since".split())
_CLOCK_NUMBER = re.compile(r"\d{1,2}(?:[.:]\d\d)?")
GERMAN_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
_WORD = re.compile(r"[^\W\d_]+")

# --- rules: class of the word before a mark -> what may follow it at the end of a sentence ------------
# After a blank: P paragraph or text end, C closer, p other, l small letter, s small letter in a paragraph
# without capitals, 9 number, J Han or kana, L other letter, O opener, U capital, Q a word countries
# qualify, G a German month. Without a blank: l 9 J L T(hai) O as above after "+", U before a small letter
# or blank, X before anything else.
ANY = "9JLOUQG"
RULES = {
    "none": "9LOUQG",  # no word before the mark
    "one": "",  # a single letter
    "half apart": ANY,  # "a. m." and "p. m."
    "union apart": "UQG",  # "e. V."
    "states apart": "UGO9",  # "EE. UU."
    "never": "",
    "no": "JLOUQG",  # a word when small, and a number's sign only before a number
    "can": "UQGO",  # est., par., min., max. are words as well
    "month": "OUQG+LOU",
    "often": ANY + "+LOU",
    "half": ANY + "+LO",  # a.m. and p.m.
    "half hour": "9JLO+LO",  # "At 8 p.m. the ..." opens a sentence
    "country": "9JLOUG+LO",
    "sometimes": "O9UQG+LO",
    "digit": "9JLOUQ",
    "digits": "9JLOUQ+OU",
    "ordinal": "9JLO",  # "am 7. ..."
    "number": ANY + "+LOU",
    "dotted": ANY + "+LO",
    "two": "s" + ANY + "+O",
    "word": "s" + ANY + "+LOU",
    "strong": "s" + ANY + "+9JLTOUX",  # ! ? and full stops of other scripts
    "points": "9LOUQG+OUX",  # three points
}
LEFT = {name: i for i, name in enumerate(RULES)}
RIGHT = {c: i for i, c in enumerate([*"PCpls9JLOUQG", *(f"+{c}" for c in "PCpl9JLTOUX")])}


def _compile_rules() -> np.ndarray:
    out = np.zeros((len(LEFT), len(RIGHT)), bool)
    for name, said in RULES.items():
        apart, _, glued = said.partition("+")
        for c in apart:
            out[LEFT[name], RIGHT[c]] = True
        for c in glued:
            out[LEFT[name], RIGHT[f"+{c}"]] = True
    return out


ENDS = _compile_rules().tolist()
#: Of each class: what a plain capital says, or None where the word it begins matters.
CAPITAL = {name: ENDS[i][RIGHT["U"]] if ENDS[i][RIGHT["U"]] == ENDS[i][RIGHT["Q"]] == ENDS[i][RIGHT["G"]] else None for name, i in LEFT.items()}
ABBREVIATIONS = (
    dict.fromkeys(SOMETIMES, "sometimes") | dict.fromkeys(COUNTRIES, "country") | dict.fromkeys(OFTEN, "often") | {"a.m": "half", "p.m": "half"}
    | dict.fromkeys(MONTHS, "month") | dict.fromkeys(NEVER, "never") | {"est": "can", "par": "can", "min": "can", "max": "can"}
)
#: No abbreviation is longer, so no longer word need be looked up.
LONGEST = max(map(len, ABBREVIATIONS)) + 2
LONGEST_PLAIN = max(len(a) for a in ABBREVIATIONS if a.isascii() and a.isalpha())

# --- the transducer -------------------------------------------------------------------------------
MODES = ("start", "middle", "quote first", "quote later", "single first", "single later", "bracket first", "bracket later", "title")
S0, M, QF, QL, SF, SL, BF, BL, TB = range(9)
STATES = 9 * 16
SYMBOLS = (
    "fill", "end", "mark", "para", "dateline", "low double", "double", "double close E", "double close M", "double close N",
    "high E", "high M", "high N", "low single", "single", "six E", "six M", "six N", "single close E", "single close M", "single close N",
    "bracket", "bracket close E", "bracket close N", "title", "title close",
)
SYM = {name: i for i, name in enumerate(SYMBOLS)}
FILL, END, MARK, PARA, DATELINE = range(5)


def _state(mode: int, low_double: int, low_single: int, fresh: int, ended: int) -> int:
    return (((mode * 2 + low_double) * 2 + low_single) * 2 + fresh) * 2 + ended


START = _state(S0, 0, 0, 1, 0)


def _step(name: str, mode: int, ld: int, ls: int, fresh: int, ended: int) -> tuple[int, int, int, int, int, bool]:
    """One rule of the transducer: next mode and flags, and whether a sentence ends."""
    kind, _, follows = name.rpartition(" ") if name[-1] in "EMN" and name[-2] == " " else (name, "", "")

    def opened(first: int, later: int) -> int:
        if mode == S0:
            return first if fresh else later
        return later if mode == M else mode

    def closed(first: int, later: int) -> tuple[int, bool]:
        said = follows if ended else "N"
        if said == "N":
            return (M if mode in (first, later) else mode), False
        if said == "E":
            return (S0, True) if mode in (first, later, M) else (mode, False)
        if mode == first:  # the quotation opened the sentence: it goes on
            return M, False
        return (S0, True) if mode in (later, M) else (mode, False)

    if kind == "fill":
        return mode, ld, ls, 0, 0, False
    if kind == "end":
        return (S0 if mode in (S0, M) else mode), ld, ls, 1, 1, mode in (S0, M)
    if kind == "mark":
        return mode, ld, ls, 0, 1, False
    if kind == "para":
        return S0, 0, 0, 1, 0, True  # whatever was before: the start state
    if kind == "dateline":
        return mode, ld, ls, 1, 0, False
    if kind == "low double":
        return opened(QF, QL), 1, ls, 1, 0, False
    if kind == "double":
        return opened(QF, QL), ld, ls, 1, ended, False
    if kind == "high":  # closes a low quote, else opens
        if not ld:
            return opened(QF, QL), 0, ls, 1, 0, False
        to, out = closed(QF, QL)
        return to, 0, ls, 1, ended, out
    if kind == "double close":
        to, out = closed(QF, QL)
        return to, ld, ls, 1, ended, out
    if kind == "low single":
        return opened(SF, SL), ld, 1, 1, 0, False
    if kind == "single":
        return opened(SF, SL), ld, 0, 1, ended, False
    if kind == "six":
        if not ls:
            return opened(SF, SL), ld, 0, 1, 0, False
        to, out = closed(SF, SL)
        return to, ld, 0, 1, ended, out
    if kind == "single close":
        to, out = closed(SF, SL)
        return to, ld, ls, 1, ended, out
    if kind == "bracket":
        return opened(BF, BL), ld, ls, 1, 0, False
    if kind == "bracket close":
        if mode == BF and follows == "E" and ended:
            return S0, ld, ls, 1, ended, True
        return (M if mode in (BF, BL) else mode), ld, ls, 1, ended, False
    if kind == "title":
        return (TB if mode in (S0, M) else mode), ld, ls, 1, 0, False
    return (M if mode == TB else mode), ld, ls, 1, ended, False  # title close


def compile_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, ends a sentence) by symbol and state."""
    to, out = np.zeros((len(SYMBOLS), STATES), np.uint8), np.zeros((len(SYMBOLS), STATES), bool)
    for k, name in enumerate(SYMBOLS):
        for mode in range(9):
            for flags in range(16):
                *nxt, ends = _step(name, mode, flags >> 3 & 1, flags >> 2 & 1, flags >> 1 & 1, flags & 1)
                to[k, mode * 16 + flags], out[k, mode * 16 + flags] = _state(*nxt), ends
    return to, out


TO_STATE, EMITS = compile_tables()
IDLE = len(SYMBOLS)  # pads the last chunk
TO_STATE = np.vstack([TO_STATE, np.arange(STATES, dtype=np.uint8)])
EMITS = np.vstack([EMITS, np.zeros(STATES, bool)])
CHUNK = 64


def prefix_compose(func: np.ndarray) -> np.ndarray:
    """Functions of 0..i composed, for each i, by doubling; rows are functions from states to states."""
    func, step = func.copy(), 1
    while step < len(func):
        func[step:] = np.take_along_axis(func[step:], func[:-step].astype(np.intp), axis=1)
        step *= 2
    return func


def chunk_functions(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols laid out in chunks, and each chunk as a function of its start state."""
    chunks = max(-(-len(symbols) // CHUNK), 1)
    padded = np.concatenate([symbols, np.full(chunks * CHUNK - len(symbols), IDLE, np.uint8)]).reshape(chunks, CHUNK)
    func = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    flat = TO_STATE.ravel()
    for k in range(CHUNK):
        func = flat[padded[:, k, None].astype(np.int32) * STATES + func]
    return padded, func


def _scan(symbols: np.ndarray, start: int) -> np.ndarray:
    """True where a symbol ends a sentence; chunks are replayed from the states a prefix scan gives them."""
    padded, func = chunk_functions(symbols)
    func = prefix_compose(func)
    state = np.concatenate([[start], func[:-1, start]]).astype(np.uint8)
    out = np.empty(padded.shape, bool)
    for k in range(CHUNK):
        out[:, k] = EMITS[padded[:, k], state]
        state = TO_STATE[padded[:, k], state]
    return out.ravel()[: len(symbols)]


#: Symbols a paragraph may have to be stepped through beside others; longer ones are scanned.
STEPS = 1024


def transduce(symbols: np.ndarray, start: int = START) -> np.ndarray:
    """True where a symbol ends a sentence.

    A paragraph break leads to one state from all, so paragraphs are chunks whose start is known: they are
    stepped through side by side. Those of more than ``STEPS`` symbols are cut into chunks and scanned.
    """
    n = len(symbols)
    out = np.zeros(n, bool)
    begins = np.concatenate([[0], np.flatnonzero(symbols == PARA) + 1])
    size = np.diff(np.append(begins, n))
    state = np.full(len(begins), START, np.uint8)
    state[0] = start
    for i in np.flatnonzero(size > STEPS):
        out[begins[i] : begins[i] + size[i]] = _scan(symbols[begins[i] : begins[i] + size[i]], int(state[i]))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= STEPS]
    begins, size, state = begins[order], size[order], state[order]
    for k in range(int(size[0]) if len(size) else 0):
        active = int(np.searchsorted(-size, -k, side="left"))
        at = begins[:active] + k
        now = state[:active]
        out[at] = EMITS[symbols[at], now]
        state[:active] = TO_STATE[symbols[at], now]
    return out


def whole_function(symbols: np.ndarray) -> np.ndarray:
    """All symbols together as one function from states to states."""
    return prefix_compose(chunk_functions(symbols)[1])[-1]


# --- reading a text as symbols ----------------------------------------------------------------------
def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _after(text: str, at: int) -> tuple[str, int]:
    """Class of what follows: P paragraph or end, C closer, O opener, U, l, 9, J, L letters, p other."""
    if text[at : at + 1] == " " and text[at + 1 : at + 2].isalpha():
        end = at + 1
    else:
        end = _SKIP.match(text, at).end()  # type: ignore[union-attr]
    if end == len(text):
        return "P", end
    if end > at + 1 and text.count("\n", at, end) > 1:
        return "P", end
    c = text[end]
    if c.islower():
        return "l", end
    if c.isupper() or c.istitle():
        return "U", end
    if c.isdigit() or c in "£$€¥₹":
        return "9", end
    if c.isalpha():
        return ("J" if _cjk(c) else "L"), end
    if c in CLOSERS:
        return "C", end
    if c in OPENERS or c == "•":
        return "O", end
    if c in "\"'":
        opens = end > at and text[at:end].isspace() and end + 1 < len(text) and not text[end + 1].isspace()
        return ("O" if opens else "C"), end
    return "p", end


_CLOSE_TAGS = re.compile(r"(?:</[a-zA-Z][^<>]*>)+")
_OPENERS = "(\"“„«‘'’[（—–/>"
_BREAK = re.compile(rf"\s|[{re.escape(_OPENERS)}]")


class Lexer:
    """Reads ``text[first:last]`` as symbols; what lies around it is looked at, not read.

    ``small``: whether the paragraphs that the range begins and ends in have no capital letter, where they
    reach beyond ``text``.
    """

    def __init__(self, text: str, first: int = 0, last: int | None = None, small: tuple[bool | None, bool | None] = (None, None)):
        self.text, self.first, self.size = text, first, len(text) if last is None else last
        self.small_edges = small
        self.symbols: list[int] = []
        self.places: list[int] = []
        self.read_to = self.skip = first
        self.dot = -1  # end of the last mark
        self.paragraph = (0, -1, False)
        dashes = "—" in text or "–" in text
        self.datelines = {m.start(): m.end() for m in _DATELINE.finditer(text)} if dashes else {}
        for s, e in self.datelines.items():
            if first == 0 and not text[:s].strip():
                self._dateline(e)

    def _before(self, at: int, marks: str = "_") -> tuple[str, int]:
        """The word or number that ends, but for blanks, at ``at`` ('' if none, or longer than any that matters), and its start."""
        text, end = self.text, at
        while end > 0 and text[end - 1].isspace():
            end -= 1
        begin = end
        while begin > 0 and end - begin < 8 and (text[begin - 1].isalnum() or text[begin - 1] in marks):
            begin -= 1
        return ("" if end == at or end - begin == 8 else text[begin:end]), begin

    def hour(self, at: int) -> bool:
        """Whether the "p.m" that begins at ``at`` belongs to an hour that opens a sentence."""
        number, at = self._before(at, "_.:")
        if not _CLOCK_NUMBER.fullmatch(number):
            return False
        word, at = self._before(at)
        if word not in BEFORE_HOUR:
            return False
        # nothing but blanks between it and a final mark, a closer, a line break or the text's start
        text, end = self.text, at
        while end > 0 and text[end - 1].isspace():
            end -= 1
            if text[end] == "\n":
                return True
        return end == 0 or text[end - 1] in ".!?…”\"’')»—"

    def _dateline(self, end: int) -> None:
        self.symbols.append(DATELINE)
        self.places.append(end)
        self.skip = self.read_to = end

    def add(self, symbol: int, begin: int, end: int, place: int) -> None:
        """A symbol at begin..end, after FILL if anything but blanks, closers and tags lies before it."""
        if begin > self.read_to and (self.text[begin - 1].isalnum() or _GAP.match(self.text, self.read_to, begin).end() < begin):  # type: ignore[union-attr]
            self.symbols.append(FILL)
            self.places.append(begin)
        self.symbols.append(symbol)
        self.places.append(place)
        self.read_to = end

    def small(self, at: int) -> bool:
        """True in a paragraph without a capital letter: there a small letter may open a sentence."""
        a, b, said = self.paragraph
        if not a <= at < b:
            a = self.text.rfind("\n\n", 0, at) + 1
            b = self.text.find("\n\n", at)
            head, tail = self.small_edges
            if a == 0 and head is not None:
                said = head
            elif b < 0 and tail is not None:
                said = tail
            else:
                said = self.text[a : b if b >= 0 else len(self.text)].islower()
            self.paragraph = (a, b if b >= 0 else len(self.text) + 1, said)
        return said

    # --- marks
    def left(self, a: int) -> str:
        """Class of the word before a full stop at ``a``."""
        text = self.text
        if a == 0 or text[a - 1].isspace():
            return "none"
        if a > LONGEST_PLAIN and (tail := text[a - LONGEST_PLAIN - 1 : a]).isascii() and tail.isalpha():
            return "word"
        low = max(0, a - LONGEST - 1)
        piece = text[low:a]
        token = piece.rsplit(None, 1)[-1]
        if token.isascii() and token.isalpha():
            if len(token) > LONGEST_PLAIN:
                return "word"
        else:
            token = token[max(map(token.rfind, _OPENERS)) + 1 :]
            if not token:
                return "none"
        cut_at = len(piece) - len(token)
        if cut_at == 0 and low > 0:  # longer than any abbreviation
            return "dotted" if self.dot > 0 and not _BREAK.search(text, self.dot, a) else "number" if token.isdigit() else "word"
        if not token.isascii():
            token = unicodedata.normalize("NFC", token.replace("­", "").replace("​", ""))
        bare = token.lower().rstrip(".")
        if bare in ("no",):
            return "no" if token in ("no", "No") else "never"
        if len(bare) <= 2 and bare in ("m", "uu", "v"):
            before = text[max(0, low + cut_at - 4) : low + cut_at]
            if bare == "m" and re.search(r"(?<!\w)[aApP]\.\s$", before):
                return "half hour" if self.hour(low + cut_at - 3) else "half apart"
            if bare == "uu":
                return "states apart"
            if token == "V" and re.search(r"(?<!\w)e\.\s$", before):
                return "union apart"
        known = ABBREVIATIONS.get(bare)
        if known == "half" and self.hour(low + cut_at):
            return "half hour"
        if known == "can":
            return "can" if token in ("est", "par", "min", "max") else "never"
        if len(bare) == 1 and bare.isalpha():
            return "one"
        if known:
            return known
        if bare.isdigit():
            return "number" if len(bare) > 2 else "ordinal" if self._before(low + cut_at)[0] in BEFORE_ORDINAL else "digit" if len(bare) == 1 else "digits"
        if "." in bare.replace("...", ""):
            return "dotted"
        return "two" if len(bare) == 2 and bare.isalpha() else "word" if bare else "none"

    def right(self, b: int, capital_word: bool) -> str:
        text = self.text
        kind, nxt = _after(text, b)
        if nxt == b:
            if kind == "U":
                after = text[nxt + 1 : nxt + 2]
                return "+U" if after.islower() or after.isspace() else "+X"
            return "+T" if kind == "L" and "ก" <= text[nxt] <= "๿" else "+" + kind
        if kind == "l":
            return "s" if self.small(nxt) else "l"
        if kind == "U" and capital_word:
            word = _WORD.match(text, nxt)
            said = word.group().lower() if word else ""
            return "Q" if said in QUALIFIED else "G" if said in GERMAN_MONTHS else "U"
        return kind

    def mark(self, a: int) -> None:
        text, b = self.text, a + 1
        c = text[b : b + 1]
        if c == " " and text[a] == ".":  # by far the commonest case, without the detours
            left = self.left(a)
            said = CAPITAL[left]
            if said is not None and text[b + 1 : b + 2].isupper():
                self.skip = self.dot = b
                if self.read_to < a:
                    if not (text[a - 1].isalnum() or _GAP.match(text, self.read_to, a).end() < a):  # type: ignore[union-attr]
                        return self.add(END if said else MARK, a, b, b)
                    self.symbols.append(FILL)
                    self.places.append(a)
                self.symbols.append(END if said else MARK)
                self.places.append(b)
                self.read_to = b
                return None
            self.skip = b
            return self.finish(a, b, left)
        while b < len(text) and text[b] in TERMINAL:
            b += 1
        run = text[a:b]
        if run == ".":
            left = self.left(a)
        else:
            left = "strong" if "!" in run or "?" in run or run == ";" or run[-1] in STRONG else "points"
        self.skip = b
        return self.finish(a, b, left)

    def finish(self, a: int, b: int, left: str) -> None:
        self.dot = b
        if ENDS[LEFT[left]][RIGHT[self.right(b, CAPITAL[left] is None)]]:
            t = _CLOSE_TAGS.match(self.text, b) if self.text.startswith("</", b) else None
            end = t.end() if t else b
            self.add(END, a, end, end)
        else:
            self.add(MARK, a, b, b)

    # --- layout
    def newline(self, a: int) -> None:
        """A blank line, or a line break before a list or clock line, ends a paragraph; others are blanks."""
        blank = _BLANK_LINE.match(self.text, a)
        if blank:
            b = self.skip = blank.end()
        elif _LIST_LINE.match(self.text, a) or _CLOCK_LINE.match(self.text, a):
            b = a + 1
        else:
            return
        self.add(PARA, a, b, a)
        if b in self.datelines:
            self._dateline(self.datelines[b])

    # --- quotes and brackets
    def follows(self, b: int, a: int) -> str:
        """What follows a closing mark: E a sentence may begin, M perhaps, N it goes on."""
        kind, nxt = _after(self.text, b)
        if kind in "U9O":
            return "E"
        if kind in "JL":
            return "N" if self.text[a] == "」" and self.text[nxt] in "とっがはをのにでもへや" else "M"
        return "N"

    def double(self, a: int, c: str) -> None:
        text = self.text
        if c == "„":
            name = "low double"
        elif c == "“":
            name = f"high {self.follows(a + 1, a)}"
        elif c == '"':
            before = text[a - 1] if a else " "
            opening = before.isspace() or (before in "([—–>" and not text.startswith("</", text.rfind("<", 0, a)))
            name = "double" if opening else f"double close {self.follows(a + 1, a)}"
        else:
            name = "double" if c in "«「" else f"double close {self.follows(a + 1, a)}"
        self.add(SYM[name], a, a + 1, a + 1)

    def single(self, a: int, c: str) -> None:
        text = self.text
        inside_word = a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_")
        word_after = a + 1 < len(text) and (text[a + 1].isalnum() or text[a + 1] == "_")
        if c != "’" and not inside_word and word_after:
            name = "low single" if c == "‚" else f"six {self.follows(a + 1, a)}" if c == "‘" else "single"
        elif c != "‚" and not word_after:
            name = f"single close {self.follows(a + 1, a)}"
        else:
            return  # an apostrophe
        self.add(SYM[name], a, a + 1, a + 1)

    def bracket(self, a: int, c: str) -> None:
        name = "bracket" if c in "([（［" else "bracket close N" if self.follows(a + 1, a) == "N" else "bracket close E"
        self.add(SYM[name], a, a + 1, a + 1)

    def title(self, a: int, c: str) -> None:
        self.add(SYM["title" if c in "『《〈【" else "title close"], a, a + 1, a + 1)

    def question(self, a: int) -> None:
        """The Greek question mark."""
        if a and ("Ͱ" <= self.text[a - 1] <= "Ͽ" or "ἀ" <= self.text[a - 1] <= "῿"):
            self.finish(a, a + 1, "strong")

    def read(self) -> tuple[list[int], list[int]]:
        """Symbols of the range, and the position, end exclusive, at which each would end a sentence."""
        text, first, last = self.text, self.first, self.size
        extra = [(m.start(), END) for m in _THAI.finditer(text)] if any("ก" <= c <= "๏" for c in set(text)) else []
        extra = sorted(((p, s) for p, s in extra + [(m.end(), PARA) for m in _CLOCK.finditer(text)] if first <= p < last or p == len(text)), reverse=True)
        kinds = _KIND.get
        for m in _CANDIDATE.finditer(text, first, last):
            a = m.start()
            while extra and extra[-1][0] <= a:
                at, symbol = extra.pop()
                if at >= self.skip and not (symbol == PARA and at == a and text[a] == "\n" and _BLANK_LINE.match(text, a)):
                    self.add(symbol, at, at, at)
            if a < self.skip:
                continue
            c = text[a]
            kind = kinds(c)
            if kind == "mark":
                self.mark(a)
            elif kind == "newline":
                self.newline(a)
            elif kind == "question":
                self.question(a)
            elif kind is not None:
                getattr(self, kind)(a, c)
        for at, symbol in reversed(extra):
            if at >= self.skip:
                self.add(symbol, at, at, at)
        if self.read_to < last and _GAP.match(text, self.read_to, last).end() < last:  # type: ignore[union-attr]
            self.symbols.append(FILL)
            self.places.append(last)
        return self.symbols, self.places


_KIND = {c: "mark" for c in TERMINAL} | {c: "double" for c in '"“”„«»「」'} | {c: "single" for c in "'‘’‚"} | {c: "bracket" for c in "()[]（）［］"}
_KIND |= {c: "title" for c in "『』《》〈〉【】"} | {"\n": "newline", ";": "question"}


def read(text: str) -> tuple[list[int], list[int]]:
    return Lexer(text).read()


def _spans(text: str, cuts: list[int], first: int, last: int) -> list[tuple[int, int]]:
    """Between cuts, the stretches of ``text[first:last]`` without blanks around; the last may be open."""
    spans, at = [], first
    for c in [*cuts, last]:
        piece = text[at:c]
        body = piece.strip()
        start = at + len(piece) - len(piece.lstrip()) if body else at
        spans.append((start, start + len(body)))
        at = max(at, c)
    return spans


def split(texts: list[str]) -> list[np.ndarray]:
    """For each text an array of (start, end) of its sentences."""
    symbols: list[int] = []
    places: list[list[int]] = []
    for t in texts:
        s, p = read(t)
        symbols += s
        symbols.append(PARA)  # texts do not touch
        places.append([*p, len(t)])
    ends = transduce(np.array(symbols, np.uint8))
    out, k = [], 0
    for t, p in zip(texts, places, strict=True):
        cuts = np.array(p, np.int64)[ends[k : k + len(p)]].tolist()
        k += len(p)
        out.append(np.array([s for s in _spans(t, cuts, 0, len(t)) if s[1] > s[0]], np.int64).reshape(-1, 2))
    return out


# --- long documents in pieces -------------------------------------------------------------------------
#: Documents longer than this are cut into pieces of at least this many characters.
LONG = 200_000
#: Characters of its surroundings a piece brings along.
PAD = 64
_SAFE = (
    re.compile(r"\n[^\S\n]*\n\s*(?=\S)"),
    re.compile(r"[^\W\d_]{4,}[ ](?=[^\W\d_]{4,}[ ][^\W\d_]{4,}[ ])"),
    re.compile(r"[぀-ヿ㐀-鿿]{3}(?=[぀-ヿ㐀-鿿]{3})"),
)


def piece_bounds(text: str, size: int) -> list[int]:
    """Where a text is cut: 0, places across which no rule looks, about ``size`` apart, and its length."""
    out = [0]
    while len(text) - out[-1] > 2 * size:
        near = out[-1] + size
        found = [m.end() for m in (r.search(text, near, near + size) for r in _SAFE) if m]
        if not found:
            found = [m.end() for m in (r.search(text, near) for r in _SAFE) if m]
        if not found:
            break
        out.append(found[0])
    return [*out, len(text)]


def pieces(doc: int, text: str, size: int) -> pd.DataFrame:
    bounds = piece_bounds(text, size)
    rows = []
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        low, high = max(0, a - PAD), min(len(text), b + PAD)
        edges = []
        for at in (a, b):
            p, q = text.rfind("\n\n", 0, at) + 1, text.find("\n\n", at)
            edges.append(text[p : q if q >= 0 else len(text)].islower())
        rows.append((doc, k, low, a - low, b - low, edges[0], edges[1], text[low:high], b == len(text)))
    return pd.DataFrame(rows, columns=PIECE_COLUMNS)


PIECE = "doc_id long, k int, low long, first int, last int, head boolean, tail boolean, piece string, final boolean"
PIECE_COLUMNS = ["doc_id", "k", "low", "first", "last", "head", "tail", "piece", "final"]


def _piece_symbols(r) -> tuple[list[int], list[int]]:
    head = None if r.low == 0 and r.first == 0 else bool(r.head)
    tail = None if r.final else bool(r.tail)
    symbols, places = Lexer(r.piece, r.first, r.last, (head, tail)).read()
    return (symbols + [PARA], places + [r.last]) if r.final else (symbols, places)


def _cut_pieces(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["t"], strict=True):
                yield pieces(int(i), t, size)

    return run


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        f = [whole_function(np.array(_piece_symbols(r)[0], np.uint8)).tobytes() for r in pdf.itertuples()]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "k": pdf["k"].to_numpy(), "f": np.array(f, object)})


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start states of a document's pieces: the functions of the pieces before composed by prefix scan."""
    pdf = pdf.sort_values("k")
    func = prefix_compose(np.stack([np.frombuffer(f, np.uint8) for f in pdf["f"]]))
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "k": pdf["k"].to_numpy(), "state": np.concatenate([[START], func[:-1, START]]).astype(np.int32)})


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per piece its stretches between ends; the first and the last may belong to sentences of its neighbours."""
    for pdf in batches:
        for r in pdf.itertuples():
            symbols, places = _piece_symbols(r)
            ends = transduce(np.array(symbols, np.uint8), int(r.state))
            cuts = np.array(places, np.int64)[ends].tolist()
            spans = np.array(_spans(r.piece, cuts, r.first, r.last), np.int64) + int(r.low)
            n = len(spans)
            order = np.arange(n)
            yield pd.DataFrame({"doc_id": np.full(n, r.doc_id), "k": np.full(n, r.k, np.int32), "start_pos": spans[:, 0], "end_pos": spans[:, 1], "edge": (order == 0) | (order == n - 1), "opens": order > 0})


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stretches at the edges of pieces put together: one begins where ``opens``, the others go on."""
    pdf = pdf.sort_values(["k", "start_pos", "opens"], kind="stable")
    which = pdf["opens"].to_numpy().cumsum()
    some = pdf["end_pos"].to_numpy() > pdf["start_pos"].to_numpy()
    g = pdf[some].groupby(which[some])
    return pd.DataFrame({"doc_id": g["doc_id"].first().to_numpy(), "start_pos": g["start_pos"].min().to_numpy(), "end_pos": g["end_pos"].max().to_numpy()})


SPAN = "doc_id long, start_pos long, end_pos long"


def long_sentences(docs: DataFrame, size: int) -> DataFrame:
    """Sentences of ``id, t``, each document cut into pieces that different tasks read."""
    work = cut(docs.mapInPandas(_cut_pieces(size), PIECE).repartition("doc_id", "k"), "pieces")
    starts = work.mapInPandas(_functions, "doc_id long, k int, f binary").groupBy("doc_id").applyInPandas(_starts, "doc_id long, k int, state int")
    told = work.join(starts, ["doc_id", "k"]).mapInPandas(_replay, SPAN.replace("long, start", "long, k int, start") + ", edge boolean, opens boolean")
    told = cut(told, "stretches")
    inner = told.filter("not edge and end_pos > start_pos").select("doc_id", "start_pos", "end_pos")
    return inner.union(told.filter("edge").groupBy("doc_id").applyInPandas(_joined, SPAN))


#: Characters handled together.
BATCH_CHARS = 1_000_000


def sentences(docs: DataFrame, did: str, text: str, long: int = LONG) -> DataFrame:
    """``doc_id, start_pos, end_pos``: one row per sentence, positions in code points, end exclusive.

    Whole texts, whatever their length. Repeated rows count once; null ids are left out; null, empty
    and blank texts have no sentence. Columns beside the two named do not matter. Rows of one id with
    different texts give the sentences of each. ``long``: characters beyond which a document is cut into
    pieces that go to different tasks; the result does not depend on it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(ids: list[int], texts: list[str]) -> pd.DataFrame:
            spans = split(texts)
            n = [len(s) for s in spans]
            both = np.concatenate(spans) if spans else np.empty((0, 2), np.int64)
            return pd.DataFrame({"doc_id": np.repeat(np.array(ids, np.int64), n), "start_pos": both[:, 0], "end_pos": both[:, 1]})

        for pdf in batches:
            ids: list[int] = []
            texts: list[str] = []
            size = 0
            for i, t in zip(pdf["id"], pdf["t"], strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= BATCH_CHARS:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield emit(ids, texts)

    one = docs.filter(F.col(did).isNotNull() & F.col(text).isNotNull()).select(F.col(did).cast("long").alias("id"), F.col(text).alias("t"))
    short = one.filter(F.length("t") <= long).mapInPandas(run, SPAN)
    far = one.filter(F.length("t") > long)
    if far.isEmpty():
        return short.distinct()
    # a long text given twice is read once; texts that share an id are kept apart while they are in pieces
    far = far.distinct().withColumn("_own", F.xxhash64("id", "t"))
    names = far.select(F.col("_own").alias("doc_id"), "id").distinct()
    found = long_sentences(far.select(F.col("_own").alias("id"), "t"), long // 2).join(names, "doc_id").select(F.col("id").alias("doc_id"), "start_pos", "end_pos")
    return reduce(DataFrame.union, [short, found]).distinct()
