"""Dialogue of subtitle files as comparable words.

Words are reduced to what damage leaves alone. Non-ASCII characters go (so a letter lost to a wrong encoding, to '?' or
to a replacement mark is the same as the letter itself), and letters and letter pairs that recognition confuses
become one form (so 'm' is 'rn', 'd' is 'cl', 'l', '1' and 'i' are one).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from typing import NamedTuple

#: Look-alikes of recognition errors, spelled out so that a single letter and its pair become the same (fixed value).
_ALIKE = str.maketrans(
    {"d": "ei", "h": "ii", "m": "rn", "w": "vv", "u": "ii", "l": "i", "1": "i", "|": "i", "0": "o", "a": "o", "c": "e", "f": "t", "5": "s", "9": "g", "q": "g", "8": "b", "6": "b"}
)
#: Letters that have no decomposition into a plain one (fixed value).
_PLAIN = str.maketrans({"ł": "l", "Ł": "L", "ß": "ss", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "đ": "d", "ı": "i"})
_MARKUP = re.compile(r"<[^<>]{0,200}>|\{[^{}]{0,200}\}|&[a-zA-Z]{2,8};|&#\d{1,6};")
_LABEL = re.compile(r"^[\s\-–—]*[^\W\d_][\w' .]{0,24}:\s+")
_TIMES = re.compile(r"^\s*\d{1,3}:\d\d(?::\d\d)?[.,:]\d{1,4}\s*-+>")
#: Songs' marks, also after a wrong decoding (fixed values).
_MUSIC = ("♪", "♫", "â™ª", "â™«", "Ã¢â„¢Âª")
#: A byte-order mark, also decoded as a one-byte encoding once or twice.
_MARK = re.compile(r"\A\s*(?:\ufeff|ï»¿|Ã¯Â»Â¿)+")
_LETTERS = re.compile(r"[^a-z]")
#: The end of a line that is a web address: labels of letters, digits and hyphens, and maybe a path.
_ADDRESS = re.compile(r"(?:^|[\s(])(?:https?://|www\.)?(?:[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?\.)+[a-z]{2,10}(?:/\S*)?[\s)]*$")

_memo: dict[str, str] = {}


def fold(word: str) -> str:
    """The comparable form of a word; empty if it has no ASCII letter or digit that counts."""
    got = _memo.get(word)
    if got is None:
        text = unicodedata.normalize("NFC", word).encode("ascii", "ignore").decode().lower()
        got = _LETTERS.sub("", text.translate(_ALIKE))
        if len(_memo) > 500_000:  # bounds a worker's memory
            _memo.clear()
        _memo[word] = got
    return got


def fold_plain(word: str) -> str:
    """The form of a word whose accents were stripped, not lost."""
    text = unicodedata.normalize("NFKD", word.translate(_PLAIN))
    return fold("".join(c for c in text if not unicodedata.combining(c)))


class Cue(NamedTuple):
    lines: list[str]
    words: list[str]
    aside: bool
    credit: bool
    music: bool


def forms(phrases: Iterable[str]) -> tuple[str, ...]:
    """Phrases as ``cues`` takes them: comparable words with a blank at the end."""
    return tuple(" ".join(filter(None, map(fold, p.split()))) + " " for p in phrases)


def _cue(block: list[str], phrases: tuple[str, ...]) -> Cue:
    lines, raw = [], []
    for line in block:
        line = line.strip()
        if "<" in line or "{" in line or "&" in line:
            line = _MARKUP.sub("", line).strip()
        if not line:
            continue
        lines.append(line)
        own = (_LABEL.sub("", line) if ":" in line else line).split()
        if raw and own and raw[-1][-1] in "-\u00ad\u2010" and len(raw[-1]) > 1 and raw[-1][-2].isalpha():
            raw[-1] = raw[-1][:-1] + own[0]  # hyphenated at the line's end
            own = own[1:]
        raw += own
    words = [f for w in raw if (f := _memo.get(w) if w in _memo else fold(w))]
    if not lines:
        return Cue(lines, words, False, False, False)
    first, last = lines[0].lstrip("-– ")[:1], lines[-1].rstrip(" .")[-1:]
    aside = first != "" and first in "[(*" and last in "])*"
    credit = not aside and (bool(phrases) and (" ".join(words) + " ").startswith(phrases) or bool(_ADDRESS.search(lines[-1])))
    music = any(m in line for line in lines for m in _MUSIC) or (first == "#" and last == "#")
    return Cue(lines, words, aside, credit, music)


def cues(text: str, phrases: tuple[str, ...] = ()) -> list[Cue]:
    """The cues of a file, in order, without mark-up; a file without any times is one cue.

    An aside is a cue in brackets; a credit ends in a web address or begins with any of ``phrases`` (see ``forms``).
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _MARK.sub("", text)
    blocks: list[list[str]] = []
    for line in text.split("\n"):
        if "->" in line and _TIMES.match(line):
            blocks.append([])
        elif blocks and line:
            blocks[-1].append(line)
    if not blocks:
        return [_cue(text.split("\n"), phrases)]
    for block in blocks[:-1]:
        while block and not block[-1].strip():
            block.pop()
        if block and block[-1].strip().isdigit():  # the next cue's number
            block.pop()
    return [_cue(b, phrases) for b in blocks]


def dialogue(text: str, phrases: tuple[str, ...] = ()) -> tuple[list[str], list[int], list[int]]:
    """The folded words of all cues, the cue each is in, and the cues that may be without dialogue: asides, credits and songs."""
    words: list[str] = []
    at: list[int] = []
    beside: list[int] = []
    for k, cue in enumerate(cues(text, phrases)):
        if cue.aside or cue.credit or cue.music:
            beside.append(k)
        words += cue.words
        at += [k] * len(cue.words)
    return words, at, beside
