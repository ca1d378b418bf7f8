"""Problem 8: sentences of texts in any language, by a semi-Markov dynamic program.

A blank line always ends a sentence, so each run of other lines (a block) is cut on its own. Within
a block every place where a sentence may end (after marks, closing quotes, emoji, and in Thai after
a space) is a candidate outside all balanced quotes and brackets; no other place can end one, as marks
within numbers, names of files and hosts can't, nor those before a comma. Rules only give candidates
their features: how well the words before it close a sentence, how well those after it open one, and how
a quotation there is led in and goes on. The program then chooses, over all candidates of the block, the
whole spans whose scores add up highest; a span is scored by its length, its opening words, its closing
words and mark, and the balanced quotations at its ends, jointly. Spans may be of any length: starts are
tried from the best on, until none that is left can beat what was found.

Defined results: null, empty and blank texts have no sentences; every other character that isn't
white space at an end lies in exactly one sentence; positions count code points; repeated rows give
repeated sentences; texts are taken whole. Other columns of the input aren't read.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeloom.functions.runtime import spread

# --- fixed values: words and marks ----------------------------------------------------------------

#: Abbreviations that a sentence doesn't end with; compared without case and the last period.
NEVER_LAST = frozenset(
    """mr mrs ms dr prof rev hon st mt ft gen col capt lt sgt messrs vs viz cf approx ca fig figs eq no nos nr vol vols pp pg ed eds al ch sec art ver rel
    e.g i.e z.b d.h u.a o.ä s.o bzw vgl abb tab bd hr fr frl str evtl ggf usf inkl zzgl max min tel
    sr sra srta dra pág págs aprox núm p.ej ej avda mme mlle mgr p.ex ex env art n°
    см рис стр табл гл т.е т.к напр др проф ул им руб тыс млн
    κ κα δρ π.χ χ π δηλ αρ σελ डॉ श्री पृ से मी सं प्रो رقم ص د أ พ ศ พ.ศ ค.ศ ดร นพ""".split()
)
#: Those of them that are also words of their own, and so may close a sentence before an opening word.
ALSO_WORDS = frozenset("no art max min sec col gen fig figs ed al tab rel ver млн тыс им".split())
#: Abbreviations that may end a sentence; they do before a capital.
MAYBE_LAST = frozenset("etc jr sr inc ltd co corp a.m p.m am pm u.k u.s u.s.a e.u cm mm km kg g lb oz in ft usw т.д т.п г гг в κ.λπ κλπ κ.ά".split())
_LISTED = NEVER_LAST | MAYBE_LAST
_LONGEST = max(map(len, _LISTED))
#: Words with which a speaker's part goes on after a quotation.
SPEECH = frozenset(
    """said says asked asks wrote writes texted replied answered shouted called whispered added cried is was
    fragte sagte schrieb rief antwortete meinte demanda dit répondit écrit cria ajouta preguntó dijo respondió escribió gritó añadió
    спросила спросил сказала сказал ответила ответил написала написал ρώτησε είπε απάντησε έγραψε قال قالت سأل سألت أجاب أجابت كتب كتبت صاح همس ถาม พูด กล่าว บอก ตอบ""".split()
)
#: Closing words of a speaker's part in scripts without case.
SPEECH_LAST = re.compile(r"(?:喊道|说道|问道|答道|写道|叫道|喊|说|问|答|道|叫|嚷|写|讲)[。！？]?$|ने\s+(?:लिखा|कहा|पूछा|बताया)[।!?]?$|(?:ถาม|พูด|กล่าว|บอก)\S*$")
#: How a clause goes on after a closing quote: particles and conjunctions.
GOES_ON_JA = re.compile(r"(?:と(?!ても|ころ)|って|という|の(?!で)|は(?!い|じめ)|が(?!んば)|を|に(?!も)|で(?!も|す)|も(?!う|し)|や(?!は)|など|へ|から|まで|より)")
GOES_ON_ZH = re.compile(r"(?:然后|接着|随后|于是|便|就|后|的|是|并|和|与|之|等|一[词文书])")
GOES_ON_KO = re.compile(r"(?:라고|이라고|라며|라는|하고|고|라|이라|는|은|이|가|을|를|의|에)")
#: Words that open sentences, for texts that are all small letters.
OPENERS = frozenset(
    """the a an in on at for after before as we i my this that these it was is please every nobody why how what who where when read use see note well honestly
    wait so done release older tagging according no yes he she they you das der die ein für le la les un une el los где как это""".split()
)
#: More words that open sentences, where they begin with a capital.
CAPITAL_OPENERS = OPENERS | frozenset("then there here but and or if her his our their its some many most now later once since both all also yet however they're it's er sie es wir ich dann aber und il elle nous vous mais puis ella pero luego он она они мы но потом".split())
#: Particles that close Thai sentences.
THAI_LAST, THAI_POLITE = ("ครับ", "ค่ะ", "คะ", "จ้ะ", "จ้า", "นะ", "เลย", "แล้ว", "ด้วย"), ("ครับ", "ค่ะ", "คะ", "จ้ะ", "จ้า")
#: Words that a Thai sentence doesn't open with.
THAI_FIRST = ("ครับ", "ค่ะ", "คะ", "และ", "หรือ", "แต่", "ฯ")
#: Months and their beginnings, after which a number with a period is a date.
MONTHS = re.compile(r"(?:Jan|Feb|Mär|Mar|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Oct|Nov|Dez|Dec|janv|févr|mars|avr|juin|juil|août)\w*", re.I)

OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "〈": "〉", "【": "】", "[": "]", "［": "］", "‘": "’", "〔": "〕"}
CLOSERS = "”“»›」』）)》〉】]］’〕\""
QUOTES = "”“»›」』\"’"

_EMOJI = "☀-➿⬀-⯿\U0001f000-\U0001faff♪♫️‍⃣"
_WORD_END = "。！？｡．"
_ENDS, _QUOTES = ".!?…؟۔।॥;‼⁇⁈⁉" + _WORD_END, "“”„«»‹›「」『』（）()《》〈〉【】[]［］‘’〔〕\""
_START = re.compile(rf"[{re.escape(_ENDS + _QUOTES)}{_EMOJI}]")
_RUN = {"end": re.compile(rf"[{_ENDS}]+"), "emoji": re.compile(rf"[{_EMOJI}]+(?:\s*[{_EMOJI}]+)*")}
_KIND = {c: "end" for c in _ENDS} | {c: "quote" for c in _QUOTES}
_URL, _THAI, _THAI_GAP = re.compile(r"https?://[!-~]+|www\.[!-~]+"), re.compile("[฀-๿]"), re.compile(r"(?<=[฀-๿])\s+")
_WORD = re.compile(r'[^\s“„«「（("\[¿¡,，:：/]+$')
_BLANK = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])[^\S\n\r\x0b\x0c\x85  ]*(?:(?:\r\n|[\n\r\x0b\x0c\x85  ])[^\S\n\r\x0b\x0c\x85  ]*)+")
_TAIL = re.compile(rf"(?:[”»›」』)）】\]］〕]|[.!?…。！？]|\s*[{_EMOJI}]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_TAIL_FIRST = frozenset("”›»」』)）】]］〕.!?…。！？")
_LETTERS, _DOTTED, _NUMBER_OF_ITEM = re.compile(r"[^\W\d_]"), re.compile(r"(?:\w\.)+\w"), re.compile(r"\d+[.)]\s")

_FIRST_WORD, _CLAUSE, _EMOJI_AT = re.compile(r"[^\s.,!?،]+"), re.compile(r"[^。！？.!?।\n]*[。！？.!?।]?"), re.compile(rf"[{_EMOJI}]")
_WORD_AT, _SECOND_WORD = re.compile(r"\w+"), re.compile(r"\w+\s+(\w+)")

#: Features of a candidate add up to about CUT where everything speaks for an end and to KEEP where
#: something speaks against it. An abbreviation closes a sentence badly (ABBREVIATION), one that is
#: also a word and a single letter less so; a common opening word in capitals speaks for an end after them.
CUT, KEEP, ABBREVIATION, ALSO_WORD, LETTER, OPENING = 7.0, -7.0, -12.0, -4.5, -6.5, 8.5
#: The typical length of a sentence in letters (wide ones count twice), the spread of its logarithm,
#: and the least score of a length.
TYPICAL, SPREAD, LEAST = 40.0, 1.3, -6.0


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _low(c: str) -> bool:
    """A small letter of a script with case; styled mathematical letters have none."""
    return c.islower() and c.upper() != c


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """The runs of lines between blank lines, without white space at their ends."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        inner = part.strip()
        if inner:
            start = at + len(part) - len(part.lstrip())
            yield start, start + len(inner)
        if m:
            at = m.end()


class _Block:
    """One block with its marks, the balanced quotations and the candidates."""

    def __init__(self, s: str) -> None:
        self.s = s
        self.marks = self._marks()
        first = _LETTERS.search(s)  # a block that begins with a small letter needs no capitals
        self.small = bool(first) and _low(first.group()) and not s[first.end() : first.end() + 1].isdigit()
        self.pairs = self._balance()
        self.closed = {b: a for a, b in self.pairs}
        self.covered = self._cover()
        self.at: list[int] = []
        self.evidence: list[float] = []
        self.plain = 1  # candidates at which a capital follows a plain mark, and the block's end
        self._candidates()

    def _marks(self) -> list[tuple[str, int, int]]:
        """(kind, start, end) of addresses, runs of end marks and of emoji, quotation marks, Thai gaps."""
        s = self.s
        urls = [("url", m.start(), m.end()) for m in _URL.finditer(s)] if "://" in s or "www." in s else []
        out, last, k = [], 0, 0
        for m in _START.finditer(s):
            i = m.start()
            if i < last:
                continue
            while k < len(urls) and urls[k][2] <= i:
                k += 1
            if k < len(urls) and urls[k][1] <= i:
                continue
            kind = _KIND.get(s[i], "emoji")
            last = i + 1 if kind == "quote" else _RUN[kind].match(s, i).end()
            out.append((kind, i, last))
        if urls or _THAI.search(s):
            out = sorted([*out, *urls, *(("thai", m.start(), m.end()) for m in _THAI_GAP.finditer(s))], key=lambda m: m[1])
        return out

    def _balance(self) -> list[tuple[int, int]]:
        """(open, close) of the outermost and inner balanced quotations; a lone mark doesn't count."""
        stack: list[int] = []
        waiting: dict[str, list[tuple[int, int]]] = {}  # by closing mark: (depth, place) of what it may close
        pairs = []

        def held(c: str) -> int:
            """The depth of the innermost mark that c may close, or -1."""
            found = waiting.get(c, [])
            while found and not (found[-1][0] < len(stack) and stack[found[-1][0]] == found[-1][1]):
                found.pop()
            return found[-1][0] if found else -1

        for kind, i, _ in self.marks:
            if kind != "quote":
                continue
            c = self.s[i]
            if c in "’‘" and i and self.s[i - 1].isalnum():
                k = held(c) if c == "’" and not self.s[i + 1 : i + 2].isalnum() else -1
                if k < 0:
                    continue  # an apostrophe
            else:
                k = held(c)
            if k >= 0:
                pairs.append((stack[k], i))
                del stack[k:]
            elif c in OPEN or c == '"':
                for closer in OPEN.get(c, '"'):
                    waiting.setdefault(closer, []).append((len(stack), i))
                stack.append(i)
        return pairs

    def _cover(self) -> list[tuple[int, int]]:
        """The outermost pairs in order."""
        out: list[tuple[int, int]] = []
        for a, b in sorted(self.pairs):
            if not out or a > out[-1][1]:
                out.append((a, b))
        return out

    def _word_before(self, i: int) -> str:
        """The run of characters before i that holds no space or opening mark."""
        back = 24
        while True:
            m = _WORD.search(self.s, max(0, i - back), i)
            if m is None or m.start() > i - back or i <= back:
                return m.group() if m else ""
            back *= 4

    def _back(self, k: int) -> int:
        """The end of the text before k without white space."""
        s = self.s
        while k and s[k - 1].isspace():
            k -= 1
        return k

    def _opens(self, j: int) -> float:
        """How a common opening word at j, in capitals, speaks for an end before it; an initial doesn't."""
        word = _WORD_AT.match(self.s, j)
        return OPENING if word and word.group().lower() in CAPITAL_OPENERS and not self.s.startswith(".", word.end()) else 0.0

    def _candidates(self) -> None:
        s, n, k, last = self.s, len(self.s), 0, 0
        for kind, i, stop in self.marks:
            if i < last:
                continue
            while k < len(self.covered) and self.covered[k][1] < i:
                k += 1
            inside = k < len(self.covered) and self.covered[k][0] <= i <= self.covered[k][1]
            if kind == "url":
                last = stop
                j = i + len(s[i:stop].rstrip(".,;:!?)'\"”’]"))
                if not inside and j < stop and s[j] in ".!?":
                    self._mark(j, stop)
                continue
            if kind == "quote":
                if inside and i == self.covered[k][1]:
                    end = _TAIL.match(s, i + 1).end()
                    inner = s[self._back(i) - 1 : self._back(i)]
                    after = s[i + 1 : end].strip(CLOSERS + " \n\r\t  ")
                    if after and after[0] in ".!?…。！？":
                        self._put(end, self._plain(end, after[0], *self._next(end)))
                    elif inner and (inner in ".!?…؟۔।॥;" + _WORD_END or inner in "”»"):
                        self._put(end, self._quote(self.covered[k][0], i, end))
                    elif after:
                        self._put(end, self._emoji(end))
                    last = end
                continue
            if inside:
                continue
            if kind == "end":
                if stop == i + 1 and s[stop : stop + 1] == " " and s[stop + 1].isupper():  # the plain case of what follows
                    word = s[s.rfind(" ", 0, i) + 1 : i] if s[i] == "." else "!"
                    if word == "!" and s[i] in "!?" or len(word) > 2 and word.isalpha() and word.lower() not in _LISTED:
                        self._put(stop, CUT)
                        self.plain += 1
                        continue
                self._mark(i, stop)
                last = max(last, self.at[-1] if self.at and self.at[-1] > i and self.evidence[-1] > KEEP else stop)
            elif kind == "emoji":
                end = _TAIL.match(s, stop).end()
                self._put(end, self._emoji(end))
                last = end
            elif kind == "thai" and stop < n:
                if s.endswith(THAI_LAST, 0, i) and not s.startswith(THAI_FIRST, stop):
                    self._put(i, 4.0 if s.endswith(THAI_POLITE, 0, i) else -1.0)
        self._put(n, CUT)

    def _put(self, at: int, evidence: float | None) -> None:
        """Add a candidate; None stands for a place that can't be an end."""
        if evidence is None:
            return
        if self.at and self.at[-1] > at and self.evidence[-1] <= KEEP:
            self.at.pop()
            self.evidence.pop()
        if self.at and self.at[-1] >= at:
            self.evidence[-1] = max(self.evidence[-1], evidence) if self.at[-1] == at else self.evidence[-1]
            return
        self.at.append(at)
        self.evidence.append(evidence)

    def _next(self, end: int) -> tuple[str, bool, int]:
        """(the next character that isn't space, whether space came first, its place)."""
        c = self.s[end : end + 1]
        if not c.isspace():
            return c, False, end
        j = end + 1
        while j < len(self.s) and self.s[j].isspace():
            j += 1
        return self.s[j : j + 1], True, j

    def _mark(self, i: int, stop: int) -> None:
        """A run of end marks from i."""
        s = self.s
        run = s[i:stop].strip()
        if not run or (run[0] == ";" and not ("Ͱ" <= s[self._back(i) - 1 : self._back(i)] <= "Ͽ")):
            return
        if run == ";" and not self._next(stop)[1] and stop < len(s):
            return
        end, (nxt, spaced, j) = stop, self._next(stop)
        if nxt in _TAIL_FIRST or nxt >= "☀":  # closing marks or emoji follow
            end = _TAIL.match(s, stop).end()
            if end > stop:
                nxt, spaced, j = self._next(end)
        dots = run
        if not nxt:
            self._put(len(s), CUT)
        elif set(dots) <= {"."} and len(dots) == 1:
            self._put(end, self._period(i, end, self._word_before(i), nxt, spaced, j))
        elif dots[0] in "…" or dots.startswith(".."):
            self._put(end, self._ellipsis(nxt, spaced))
        else:
            self._put(end, self._plain(end, dots[-1], nxt, spaced, j))

    def _plain(self, end: int, mark: str, nxt: str, spaced: bool, j: int) -> float | None:
        """Evidence after ! ? and their kin, or a period that nothing speaks against."""
        if not nxt:
            return CUT
        if mark in _WORD_END + "।॥؟۔":
            return CUT if nxt not in "、，,；;：:）)」』”" else None
        if _low(nxt):
            if not self.small:
                return KEEP
            opener = _WORD_AT.match(self.s, j)
            return 1.8 + (1.5 if opener and opener.group() in OPENERS else 0.0)
        if nxt in ",;:、，；：)）]":
            return None
        if nxt in "—–-":
            return -3.0
        return CUT if nxt.isupper() or spaced or not nxt.isascii() else 2.0

    def _ellipsis(self, nxt: str, spaced: bool) -> float | None:
        if _low(nxt):
            return 0.8 if self.small else KEEP
        if nxt in ",;:、，；：)）]":
            return None
        return 4.5 if nxt.isupper() or nxt in OPEN or nxt in "¿¡\"#" else 0.6

    def _period(self, i: int, end: int, word: str, nxt: str, spaced: bool, j: int) -> float | None:
        s = self.s
        if spaced and len(word) > _LONGEST and nxt.isupper() and word.isalpha():
            return CUT  # longer than any abbreviation
        low = word.lower().strip("'’").rstrip(".")
        if not spaced:
            return self._unspaced(low, word, nxt, j)
        if nxt in ",;:、，；：)）]":
            return None
        parts = low.split(".")
        if len(parts) > 1 and all(p in NEVER_LAST or len(p) == 1 and not p.isascii() for p in parts):
            return ABBREVIATION
        before = s[max(0, self._back(i - len(word)) - 3) : self._back(i - len(word))].lower() if len(low) <= 2 else ""
        spaced_abbreviation = f"{before.strip()[-2:].strip('.')}.{low}" if before.endswith(".") else ""
        if low in MAYBE_LAST and not (low == "г" and not before[-1:].isdigit()) or spaced_abbreviation in MAYBE_LAST:
            if nxt.isdigit():
                return 4.0 if _NUMBER_OF_ITEM.match(s, j) else KEEP
            return 4.0 if nxt.isupper() or nxt in OPEN or nxt in "¿¡\"#" else (CUT - 1 if not _cased(nxt) else KEEP)
        if low in NEVER_LAST or parts[-1] in NEVER_LAST or spaced_abbreviation in NEVER_LAST:
            if low in ALSO_WORDS and nxt.isupper():
                return ALSO_WORD + self._opens(j)
            return ABBREVIATION
        if len(low) == 1 and low.isalpha():
            if _cased(low) or not nxt.isascii() or nxt.isdigit():
                return LETTER + (self._opens(j) if word.isupper() and nxt.isupper() and before[-1:].isalpha() else 0.0)
            return 2.0
        if _DOTTED.fullmatch(low):
            return KEEP if not nxt.isupper() else 1.0
        if low.isdigit():
            prior = self._back(i - len(word))
            if prior <= s.rfind("\n", 0, i) + 1 or s[prior - 1] in ".!?…。！？।॥؟" + CLOSERS or _EMOJI_AT.match(s[prior - 1]):
                return ABBREVIATION  # a list number belongs to its item
            if len(low) <= 2 and MONTHS.match(s, j):
                return KEEP
        if _low(nxt) and not s[j + 1 : j + 2].isdigit() and not (word[-1:].isalpha() and not _cased(word[-1])):
            return 3.0 if self.small else KEEP
        return CUT

    def _unspaced(self, low: str, word: str, nxt: str, j: int) -> float | None:
        """A period with no space after it: within a number or a name, or a space is missing."""
        s, after = self.s, self.s[j + 1 : j + 2]
        if low in NEVER_LAST or len(low) == 1 or "." in low and all(p in NEVER_LAST or len(p) == 1 and not p.isascii() for p in low.split(".")):
            return None
        if not word or not nxt.isalpha() or not word[-1].isalpha():
            if nxt in OPEN or nxt in "¿¡\"":
                return 4.0
            if not nxt.isascii() and nxt.isalpha() and not _cased(nxt) and word[-1:].isalpha() and not word.isascii():
                return CUT - 1
            return 3.0 if nxt.isupper() and word[-1:].isdigit() and after.islower() else None
        if nxt.isupper() and (after.islower() or after.isspace()):
            return 4.5 if word[-1].islower() and len(low) > 2 else None
        if self.small and len(low) > 2:
            first = _WORD_AT.match(s, j)
            return 1.5 if first and first.group() in OPENERS and s[first.end() : first.end() + 1].isspace() else None
        return None if _cased(nxt) else 4.0

    def _emoji(self, end: int) -> float | None:
        nxt, _, j = self._next(end)
        if not nxt:
            return CUT
        if _low(nxt):
            after = _WORD_AT.match(self.s, j)
            return 0.0 if self.small and after and after.group() in OPENERS else (-1.0 if self.small else KEEP)
        if nxt in ",.;:!?、，。！？)）":
            return None
        return 4.5

    def _quote(self, a: int, b: int, end: int) -> float | None:
        """Evidence that a sentence ends with the quotation or bracket a..b that ends with a mark."""
        s = self.s
        nxt, spaced, j = self._next(end)
        if not nxt:
            return CUT
        if nxt in ",;:、，；：.)）]—–-·":
            return None
        closer, emoji = s[b], s[b + 1 : end].strip(CLOSERS)
        if closer in "》〉" or (_low(nxt) and not self.small):
            return KEEP
        lead = s[max(0, self._back(a) - 1) : self._back(a)]
        led = lead[-1:] in ",:，：、" and bool(lead)
        starts = not lead or lead[-1] in ".!?…。！？．।॥؟۔;” ”»」』）)♪" or bool(_EMOJI_AT.match(lead))
        if closer in "」』" and _CJK.match(nxt) or closer == "）" and GOES_ON_JA.match(s, j):
            if GOES_ON_JA.match(s, j) and not (closer == "）" and starts):
                return KEEP
            return 5.0 if starts or led else -2.0
        if nxt in OPEN or nxt == '"':
            if closer in "」』" and nxt in "「『":
                return -0.5 if starts else 1.0
            return 5.0 if led or b - a > 20 or closer in ")）" else 1.5
        if "가" <= nxt <= "힣" and not spaced and GOES_ON_KO.match(s, j):
            return KEEP
        bracket = closer in ")）]］】"
        word = _FIRST_WORD.match(s, j)
        says = bool(word) and word.group().lower() in SPEECH or bool(SPEECH_LAST.search(_CLAUSE.match(s, j).group().strip()))
        if bracket:
            return (5.0 if not _low(nxt) else 3.5) if starts else (-2.0 if _low(nxt) or not nxt.isupper() else 4.0)
        if closer in QUOTES and GOES_ON_ZH.match(s, j) and _CJK.match(nxt):
            return KEEP
        if starts and says:
            return -4.0
        if nxt.isupper():
            follow = _SECOND_WORD.match(s, j)
            return -1.0 if starts and follow and follow.group(1).lower() in SPEECH - {"is", "was"} else 5.0
        if _low(nxt):  # in a text of small letters
            return 3.0 if led else (-3.0 if not starts else 2.0)
        return 5.0 if led or emoji else (2.5 if starts else 1.0)


@functools.cache
def _units_table() -> np.ndarray:
    """The letters that a code point counts for: 2 for wide ones, 0 for what is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.int8)
    for cp in range(0x40000):  # no letters lie beyond
        c = chr(cp)
        if c.isalpha():
            table[cp] = 1 if cp < 0x3040 or not _CJK.match(c) else 2
    return table


def _length_score(units: int) -> float:
    """How well so many letters make one sentence; marks and numbers alone do badly."""
    return max(LEAST, -0.5 * ((math.log(units) - math.log(TYPICAL)) / SPREAD) ** 2) if units else -5.0


_LENGTH = [_length_score(u) for u in range(2048)]


def _opening(c: str, small: bool) -> float:
    """How well a span opens with c, beside what the features of the place before it say."""
    return -2.0 if _low(c) and not small else -5.0 if c in ",;:、，。！？)）." else 0.0


def _closes(c: str) -> bool:
    """Whether a span that ends with c has a mark, a quotation or an emoji at its end."""
    return c in ".!?…。！？．؟।॥;」”»" or bool(_EMOJI_AT.match(c))


def block_sentences(s: str, units: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """The sentences of one block: the spans between candidates with the best sum of scores. units: the
    letters before each character and the end.

    best is the sum up to a candidate, and a span from there adds the opening score of its start, the
    score of its length, -1 if it's short and ends without a mark, and the features of its end. All but
    the last are at most 0, so starts are tried in falling order of best until that can't win."""
    b = _Block(s)
    n = len(b.at)
    if n == 1:
        yield 0, b.at[0]
        return
    if units is None:
        units = letters_before(s)
    letters = units[[0, *b.at]].tolist()
    places = [0, *b.at]
    if b.plain == n and min(map(int.__sub__, letters[1:], letters)) >= 12:
        # every place has CUT and a good opening, and no span is short: a span scores at least -0.5 if it's shorter
        # than TYPICAL, else at least as much as any longer one, so no cut can be left out with profit
        yield from zip(places, b.at)
        return
    order = [(_opening(s[0], b.small), 0)]  # by rising value
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    for j in range(1, n + 1):
        upto, found, of = letters[j], -math.inf, j - 1
        weak = None
        for value, i in reversed(order):
            if value <= found:
                break
            u = upto - letters[i]
            total = value + (_LENGTH[u] if u < 2048 else _length_score(u))
            if u < 12 and u:
                if weak is None:
                    weak = not _closes(s[b._back(places[j]) - 1])
                total -= weak
            if total > found:
                found, of = total, i
        best[j], back[j] = found + b.evidence[j - 1], of
        if j < n:
            k = places[j]
            while s[k].isspace():
                k += 1
            entry = (best[j] + _opening(s[k], b.small), j)
            if entry > order[-1]:
                order.append(entry)
            else:
                bisect.insort(order, entry)
    cuts, j = [], n
    while j:
        cuts.append((places[back[j]], places[j]))
        j = back[j]
    yield from reversed(cuts)


def letters_before(text: str) -> np.ndarray:
    """The letters before each character of a text and its end."""
    out = np.zeros(len(text) + 1, np.int64)
    np.cumsum(_units_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], out=out[1:])
    return out


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text."""
    out = []
    if text:
        units = letters_before(text)
        for a, e in blocks(text):
            s = text[a:e]
            for i, j in block_sentences(s, units[a : e + 1]):
                while i < j and s[i].isspace():
                    i += 1
                while i < j and s[j - 1].isspace():
                    j -= 1
                if i < j:
                    out.append((a + i, a + j))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())]))


def sentence_spans(text: Column | str) -> Column:
    """The sentences of a text as an array of (start_char, end_char)."""

    @F.arrow_udf(_SPAN)
    def cut(col: pa.Array) -> pa.Array:
        coded = col.dictionary_encode()  # a text that is posted again is cut once
        once = [sentences(x) for x in coded.dictionary.to_pylist()]
        rows = [[] if k is None else once[k] for k in coded.indices.to_pylist()]
        flat = [x for r in rows for x in r]
        offsets = [0]
        for r in rows:
            offsets.append(offsets[-1] + len(r))
        spans = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64())], ["start_char", "end_char"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)

    return cut(F.col(text) if isinstance(text, str) else text)


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_char, end_char), one row per sentence."""
    cut = documents.select(F.col(key).alias("__key"), sentence_spans(text).alias("__spans"))
    return cut.select("__key", F.explode("__spans").alias("__s")).select(F.col("__key").alias(key), "__s.start_char", "__s.end_char")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")))


QUERIES = {"p8_found": p8_found}
SQL: dict[str, str] = {}
