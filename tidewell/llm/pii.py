"""Personal information in free text, found after undoing disguises.

A transducer rewrites the text piece by piece (homoglyphs, full-width and
spelled digits, ``at``/``dot`` in words or brackets) and keeps, for every
character it writes, the place it came from.  Identifiers are detected in the
rewritten text and their spans mapped back, so positions and the masked text
refer to the source.

Persons and addresses have no closed vocabulary: a candidate is two or three
words of the shape of a name (or a house number with a street), and evidence
is added up: what stands before and after it, initials, whether an address,
phone number or e-mail address follows, and whether its words are frequent
given names or end as family names do.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Look-alikes of Latin letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαοερνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSaoepvikruxABEZHIKMNOPTYX", strict=True))
INVISIBLE = set("​‌‍⁠﻿­")
# Words for digits.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
# Frequent given names; they add evidence and are not needed.
GIVEN = frozenset("adam adrian ahmed aisha alan albert alejandro alex alexander ali alice amanda amy ana andrea andreas andrew angela anna anne antonio arthur barbara ben benjamin bernd brian carla carlos carmen caroline catherine charles charlotte chen chris christian christina christopher claire clara claudia daniel david deborah diana diego dieter dmitri donald dorothy edward elena elias elizabeth emil emily emma eric eva fatima felix fernando francisco frank gabriel george giulia giovanni grace greta hanna hannah hans harry heinz helen henry hugo ian ibrahim ines ingrid isabel ivan jack jacob james jan jane javier jean jennifer jessica jim joan joe john jonas jonathan jorge jose joseph juan julia julie jürgen karen karl kate katharina kevin klaus lars laura lea leon linda lisa lucas lucia luis luke maria marie mark marta martin mary matthew max mia michael milo miguel mohammed monica nadia natalia nicholas nicole nina nora olga oliver oscar pablo patricia paul pedro peter petra philip pierre rachel raj rebecca richard robert rosa ruth samuel sandra sara sarah simon sofia sophie stefan stephen susan thomas tim tomas ursula victoria viktor wei william wolfgang yuki".split())
# Usual endings of family names, titles, and words that join family names.
FAMILY_ENDINGS = tuple("sson son sen dottir mann berg stein quist qvist ström gren rath stad mark field burn wick worth ham ley low ford ton well wood hill ovic vich escu enko ov ova ev eva sky ski ska ez poulos idis oğlu yan ian".split())
TITLES = "Dr Mr Mrs Ms Miss Prof Professor Herr Frau Sr Sra Señor Señora Mme Monsieur Madame Sir".split()
PARTICLES = frozenset("van von der den de da di del della la le ter ten zu zum zur al bin ibn dos du".split())
# What is said of no person although it looks so.
NO_PERSON = frozenset("robot universe world america president chairman speaker minister chancellor mayor pepper who bean right wrong perfect everything anyone everyone nobody somebody".split())
THINGS = frozenset("project region archive handle ticket build version release module team company group city county state lake mount mount street road lane avenue calle rue plaza place square page note atom table index the".split())
# Ordinary words that are no part of a name although they are capitalised at the start of a sentence.
FUNCTION = frozenset("a an the this that these those my our your his her its their and or but nor so if when while where why how who whom which what whoever nobody everybody somebody someone anyone there here then than once twice again after before since until unless without with within between beside behind under over near from into onto for of to in on at by as not no yes is are was were be been being has have had do does did will would can could may might must shall should half almost every each some any all both only today yesterday tomorrow now soon later earlier often rarely please page region project agents evidence reflection summary recall note ticket checksum build offset handle lane atom atoms edge edges key keys name names mail email tel phone fax address owner caller contact reminder cc hi hello dear wishes regards thanks sincerely best verified expired customer user client call met write send ship ask see der die das ein eine und oder aber ohne mit nach von vor bei warum wie el los las un una y o pero sin con por qué".split())

# Kinds of streets; the ambiguous ones are common words too.
STREET_KINDS = "street road lane avenue boulevard terrace crescent parkway highway st rd ln ave blvd ter cres pkwy hwy".split()
STREET_AMBIGUOUS = "drive close court square place way row walk gardens grove circle dr cl ct sq pl".split()

_D = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOT = r"\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\})\s*|\s+dot\s+"
_LABEL = r"[a-z0-9][a-z0-9-]*"
_DISGUISE = re.compile(
    rf"(?P<at>\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{{\s*at\s*\}})\s*|(?<=[a-z0-9])\s+at\s+(?={_LABEL}(?:\.|{_DOT})[a-z]{{2,}}))"
    rf"|(?P<dot>(?<=[a-z0-9])(?:{_DOT})(?=[a-z0-9]))"
    rf"|(?P<digits>\b(?:{_D})(?:[\s-]+(?:{_D})){{4,}}\b)",
    re.IGNORECASE,
)
_DIGIT_SET = frozenset(DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:{_D})(?:[\s-]+(?:{_D}))*\b", re.IGNORECASE)
_GAP = r"(?:[\s-]+|,\s?|\)\s?|\s?\(|[./])"
#: Spelled digits and figures side by side.
_MIXED = re.compile(rf"(?<![\w./-])(?:{_D}|\d+)(?:{_GAP}(?:{_D}|\d+))+(?!\w)", re.IGNORECASE)
_PIECE = re.compile(rf"{_D}|\d+", re.IGNORECASE)
#: Digit words with a comma after each.
_LISTED = re.compile(rf"(?<![\w-])(?:{_D})(?:, ?(?:{_D})){{9,10}}(?!,? ?(?:{_D})|\w)", re.IGNORECASE)
#: A written-out ``@``: in brackets, or between words of which the last has a dot.
_AT_FORM = re.compile(r"[\[({]\s*at\s*[\])}]|(?<=\s)at\s+[a-z0-9][a-z0-9-]*(?:\.[a-z]|\s*[\[({]\s*dot|\s+dot\s)")
_BREAKS = str.maketrans(dict.fromkeys("-,.;:!?()[]/='\"", " "))


def _short_runs(s: str) -> list[tuple[int, int]]:
    """Spelled digits beside figures (or parts of one number) that make up a number of seven digits or more.

    A lone word counts only with figures on both sides, or in a list of ten or
    eleven with commas that does not merely count up or down.
    """
    out = []
    for m in _LISTED.finditer(s):
        values = [int(DIGIT_WORDS[w.group().lower()]) for w in re.finditer(_D, m.group(), re.IGNORECASE)]
        if sum(abs(x - y) in (1, 9) for x, y in zip(values, values[1:])) < len(values) - 2:
            out.append(m.span())
    for m in _MIXED.finditer(s):
        digits = sum(len(p) if p[0].isdigit() else 1 for p in _PIECE.findall(m.group()))
        if digits < 7:
            continue
        if any(a < m.end() and m.start() < b for a, b in out):
            continue
        for w in _SPELLED.finditer(s, m.start(), m.end()):
            inside = m.start() < w.start() and w.end() < m.end() and re.search(r"\d\W*$", s[m.start() : w.start()]) and re.match(r"\W*\d", s[w.end() : m.end()])
            if len(_PIECE.findall(w.group())) > 1 or inside:
                out.append(w.span())
    return out


def _disguised(low: str, words: list[str]) -> bool:
    """Whether a lower-case text with these words may hold a disguise at all (cheap, never misses one).

    A lone digit word matters only beside the figures of the rest of a number.
    """
    if "dot" in low or "at" in low and _AT_FORM.search(low):
        return True
    if _DIGIT_SET.isdisjoint(words):
        return False
    return sum(w in _DIGIT_SET for w in words) > 1 or sum(map(str.isdigit, low)) >= 6


def _words_of(low: str) -> list[str]:
    return low.translate(_BREAKS).split()


def normalise(text: str) -> tuple[str, list[int] | None]:
    """The text without disguises, and for each of its characters the source place.

    The map is None where nothing changed.
    """
    chars: list[str] | None = None
    where: list[int] = []
    if not text.isascii():
        chars = []
        for at, c in enumerate(text):
            if c in INVISIBLE:
                continue
            if c in HOMOGLYPHS:
                new = HOMOGLYPHS[c]
            elif ord(c) > 127:
                n = unicodedata.normalize("NFKC", c)
                new = n if len(n) == 1 and n.isascii() else c
            else:
                new = c
            chars.append(new)
            where.append(at)
        if len(chars) == len(text) and "".join(chars) == text:
            chars = None
    s = text if chars is None else "".join(chars)
    low = s.lower()
    if not _disguised(low, _words_of(low)):
        return s, where if chars is not None else None
    out: list[str] = []
    back: list[int] = []
    end = 0
    changes = [(*m.span(), m.lastgroup) for m in _DISGUISE.finditer(s)]
    short = [(a, b, "digits") for a, b in _short_runs(s) if all(b <= x or a >= y for x, y, _ in changes)]
    for start, stop, kind in sorted(changes + short):
        part = s[start:stop]
        out.append(s[end:start])
        back.extend(range(end, start))
        if kind == "digits":
            for w in re.finditer(_D, part, re.IGNORECASE):
                out.append(DIGIT_WORDS[w.group().lower()])
                back.append(start + w.start())
        else:
            out.append("@" if kind == "at" else ".")
            back.append(start + len(part) - len(part.lstrip()))
        end = stop
    if not end:
        return s, where if chars is not None else None
    out.append(s[end:])
    back.extend(range(end, len(s)))
    return "".join(out), [where[b] for b in back] if chars is not None else back


_EMAIL = re.compile(r"[a-z0-9](?:[\w.+%-]*[\w+%-])?@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}", re.IGNORECASE)
_PHONE = re.compile(
    r"(?<![\w./+-])(?:"
    r"(?:\+1[-. ]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}|\+1\d{10}"
    r"|(?:\+44|0044)[ -]?(?:\(0\))?[ -]?\d{2,4}[ -]?\d{3,4}[ -]?\d{3,4}|0\d{2,4} \d{4} \d{4}"
    r"|(?:\+49|0049)[ -]?\d{2,4}[ /-]?\d{3,8}(?:[ -]\d{2,5})?|0\d{2,4}/\d{3,8}(?:-\d{1,5})?"
    r"|\+[2-9]\d{0,2}(?:[ -]?\(?\d{1,4}\)?){2,5}"
    r")(?![\w-]|[./]\d)"
)
#: Runs of figures that may be a phone number where some of them were spelled.
_FIGURES = re.compile(rf"(?<![\w./-])\+?\(?\d+(?:{_GAP}\d+)*(?![\w-]|[./]\d)")
_NUMBER_LABEL = r"(?:ssn|social security|steuer-id|tax id|taxpayer|insurance|nino|passport|pass|id card|identity card|national id|ausweis|dni)[^\d\n]{0,14}?"
_ID = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"
    r"|[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r"|\d{8}-[a-z]"
    r"|[a-z]\d{8}"
    r")(?![\w-]|\.\d)",
    re.IGNORECASE,
)
_LABELLED_ID = re.compile(rf"\b{_NUMBER_LABEL}(?P<id>(?<![\w-])(?:\d{{9}}|\d{{11}}|\d{{8}}[a-z]|[a-z]{{1,2}}\d{{6,8}}[a-z]?))(?![\w-])", re.IGNORECASE)

# A bank account or card number is no phone number; groups of it must not be read as one.
_ACCOUNT = re.compile(r"(?<![\w-])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|\d{4}([ -]?)\d{4}\1\d{4}\1\d{4})(?![\w-])")

_KIND, _LOOSE = "|".join(STREET_KINDS), "|".join(STREET_AMBIGUOUS)
_NAMES = r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*"
#: House number, up to three words, kind of street.
_ADDRESS = re.compile(rf"(?<![\w.,/-])(?<!\d )\d{{1,5}}(?: ?[a-z](?![a-z]))?,? (?P<street>{_NAMES}(?: {_NAMES}){{0,2}}?) (?P<kind>{_KIND}|{_LOOSE})\b(?: (?:{_KIND}|{_LOOSE})\b)?", re.IGNORECASE)
_ADDRESS_ROMANCE = re.compile(
    r"(?<![\w-])(?:"
    r"\d{1,5} ?[a-z]?,? (?:rue|avenue|place|boulevard|chemin|quai|impasse|allée) (?:(?:de|du|des|la|le) |d'|l')*(?P<street>[^\W\d_]{3,})(?=\W|$)"
    r"|(?:calle|avenida|avda|plaza|paseo|carrer|via|viale|corso|rua) (?:(?:de|del|la|los|las|das|dos|da|do) )*(?P<name>[^\W\d_]{3,}(?: [A-Z][^\W\d_]+)?),? (?:n[º°o]\.? ?)?\d{1,5}(?: ?[a-z])?(?!\w)"
    r")",
    re.IGNORECASE,
)
_ADDRESS_JOINED = re.compile(r"(?<![\w-])[a-zßäöü]{3,}(?:-[a-zßäöü]+)*-?(?:straße|strasse|str\.|allee|gasse|weg|platz) \d{1,4}(?: ?[a-z])?(?!\w)", re.IGNORECASE)
#: What may stand before a house number.
_PLACE_BEFORE = re.compile(r"(?:\b(?:at|to|from|in|near|on|visit|address|lives|addr|bei|en|à|au)|[:=;,|/(>\n]|^)\s*$", re.IGNORECASE)
_STREET_CUES = tuple(f" {k}" for k in STREET_KINDS + STREET_AMBIGUOUS)
_ROMANCE_CUES = ("rue ", "avenue ", "place ", "boulevard ", "chemin ", "quai ", "impasse ", "allée ", "calle ", "avenida ", "avda ", "plaza ", "paseo ", "carrer ", "via ", "viale ", "corso ", "rua ")
_JOINED_CUES = ("straße", "strasse", "str.", "allee", "gasse", "weg ", "platz ")
_NUMBERS = re.compile(r"\d[\d ().+/-]{5,}\d|\d{6}")
_NAME_WORD = r"[^\W\d_]+(?:['’-](?!s(?![^\W\d_]))[^\W\d_]+)*"
_TOKEN = re.compile(rf"{_NAME_WORD}\.?|\d+|[^\w\s]")
_TITLE = re.compile(rf"\b(?:{'|'.join(t + ('s' if t == 'Sir' else '') for t in TITLES)})\b\.?\s+$", re.IGNORECASE)
#: What is said before a person's name, and how much it tells.
_BEFORE = (
    (re.compile(r"(?:\bname\s*(?:is|=|:)|\b(?:ich heiße|me llamo|je m'appelle|i am|i'm)|\b(?:owner|author|contact|caller|attn|sender|reporter|assignee)\s*[:=,]|\b(?:best|kind|warm) (?:wishes|regards),?|\b(?:regards|sincerely|yours),)\s*$", re.IGNORECASE), 3),
    (re.compile(r"(?:\b(?:assigned to|according to|(?:spoke|talked|speak|talk|met) (?:with|to)|(?:written|signed|reviewed|reported|approved) by|contact|dear|hi,?|hello,?|cc:?|reminder:|regards|wishes|thanks)[\s,]*|(?:^|[.;]\s)cc )\s*$", re.IGNORECASE), 2),
    (re.compile(r"\b(?:met|by|ask|call|email|mail|from|to|with|for|told|tell|and|or|&)\s+$", re.IGNORECASE), 1),
)
#: What is said after it.
_AFTER = (
    (re.compile(r"\s*(?:signed off|here[,.]|asked that|wants\b|, wants\b|lives\b|\(?<?[\w.+-]+@)", re.IGNORECASE), 2),
    (re.compile(r"\s*(?:said|asked|wrote|near\b|meanwhile|reviewed|replied|reported|confirmed|agreed|approved|joined|called|moved|thinks|told|and left|about the|'s\b|[;,|/]\s*(?:e-?mail|tel|phone|mobile|address|handle)\b|or\b|on the\b)", re.IGNORECASE), 1),
)


#: Two capitalised words side by side, an initial, or a title: without any of these only lower-case names are possible.
_NAME_LIKE = re.compile(rf"[A-ZÀ-ÞŒŠŽĀ-Ž][\w'’.-]*,? (?:\w\. ?)*(?:(?:{'|'.join(sorted(PARTICLES))}) )*[A-ZÀ-ÞŒŠŽĀ-Ž]|(?i:\b(?:{'|'.join(TITLES)})\b)")
#: Between a name and a find of another type in one record.
_NEXT_FIELD = re.compile(r"(?:\s*[;,|/(<:-]+\s*|\s*\n\s*)(?:[a-z-]{2,9}\s*[=:]\s*)?", re.IGNORECASE)
#: Between a street address and its town.
_TOWN = re.compile(r"(?:,\s*|\s+in\s+)(?:\d{4,6}\s+)?$")


def _ends_as_family(word: str) -> bool:
    low = word.lower().rsplit("-", 1)[-1]
    return len(low) > 4 and low.endswith(FAMILY_ENDINGS)


def _shape(word: str, loose: bool) -> bool:
    """Whether a word can be part of a name: capitalised, or anything where the text has no usual case."""
    if word.lower() in FUNCTION or len(word) < 2:
        return False
    return loose or word[0].isupper() and (len(word) < 3 or not word.isupper())


def persons(s: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Names of persons in ``s``, where ``taken`` are the finds of other types.

    ``Given Family``, ``Given I. Family``, ``G. Family``, ``Family, Given``, or
    one word after a title; with two family names or particles between.
    Evidence of two is enough for capitalised words, three for others.
    """
    low = s.lower()
    starts, ends = {a for a, _ in taken}, [b for _, b in taken]
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(s)]
    done = 0

    def gap(i: int) -> str:
        return s[tokens[i][2] : tokens[i + 1][1]] if i + 1 < len(tokens) else "\n"

    def word(i: int) -> str:
        return tokens[i][0] if i < len(tokens) and (tokens[i][0][0].isalpha()) else ""

    def family(i: int, loose: bool) -> int:
        """Where a family name that begins at token ``i`` ends (its token), or -1."""
        while word(i).lower() in PARTICLES and gap(i) == " " and word(i + 1):
            i += 1
        w = word(i)
        if not w or not _shape(w.rstrip("."), loose):
            return -1
        return i

    for i, (text, a, _) in enumerate(tokens):
        if a < done or not text[0].isalpha():
            continue
        bare = text.rstrip(".")
        if len(bare) > 1 and (not (bare[0].isupper() or bare in GIVEN or _lower_case_name(low, tokens, i, taken)) or bare.lower() in FUNCTION and bare.lower() not in GIVEN):
            continue
        before, after_title = s[max(0, a - 40) : a], False
        if before and before[-1] in "@_-./" and not before.endswith("mail=") or "'" in before[-1:]:
            continue
        score, end, loose = 0, -1, not bare[0].isupper() or len(bare) > 2 and bare.isupper()
        if _TITLE.search(before):
            after_title, score = True, 2
        if len(bare) == 1:  # initials
            j = i
            while len(word(j).rstrip(".")) == 1 and word(j).endswith(".") and gap(j) in (" ", "") and j - i < 3:
                j += 1
            if j == i or re.search(r"\d\s$", before):
                continue
            k = family(j, loose)
            if k < 0 or word(k).lower() in GIVEN and not _ends_as_family(word(k)):
                continue
            score += 1 + _ends_as_family(word(k).rstrip("."))
            end = k
        else:
            if text.endswith(".") and not _last_of_sentence(text):
                continue
            k = -1
            if gap(i) == " " and not text.endswith("."):
                j = i + 1
                while len(word(j).rstrip(".")) == 1 and word(j).endswith(".") and gap(j) == " ":
                    j += 1
                k = family(j, loose)
                if k > 0 and any(gap(x) != " " for x in range(i, k)):
                    k = -1
            if k > 0:
                known = bare.lower().split("-")[0] in GIVEN
                score += 2 * known + _ends_as_family(word(k).rstrip(".")) + (k > i + 1)
                end = k
                further = family(k + 1, loose) if gap(k) == " " and not word(k).endswith(".") else -1
                if further > 0 and _ends_as_family(word(further).rstrip(".")) and (word(k).lower() in GIVEN or _ends_as_family(word(k))) and not loose:
                    end = further
            elif _shape(bare, loose) and gap(i) == "" and i + 2 < len(tokens) and tokens[i + 1][0] == "," and gap(i + 1) == " " and (family(i + 2, loose) == i + 2):
                # Family, Given
                other = word(i + 2).rstrip(".")
                score += 2 * (other.lower() in GIVEN) + _ends_as_family(bare)
                if not (other.lower() in GIVEN or _ends_as_family(bare)) or loose and other.lower() not in GIVEN:
                    if not after_title:
                        continue
                end = i + 2
            if end < 0 and after_title and _shape(bare, False) and not (bare.lower() in NO_PERSON or bare.lower() in STREET_KINDS or bare.lower() in STREET_AMBIGUOUS):
                end = i
            if end < 0:
                continue
            if not _shape(bare, loose) and bare.lower() not in GIVEN:
                continue
        if any(x < tokens[end][2] and tokens[i][1] < y for x, y in taken):
            continue
        left = re.search(r"([^\W_]+)\W*$", before)
        if left and left.group(1).lower() in THINGS and not before.rstrip().endswith((".", "!", "?", ";", "\n")):
            continue
        cased = {w[0].isupper() for x in range(i, end + 1) if (w := word(x)) and w.lower() not in PARTICLES}
        if len(cased) > 1 or not after_title and any(b < a and _TOWN.fullmatch(s, b, a) for b in ends):
            continue
        if any(word(x).rstrip(".").lower() in STREET_KINDS for x in range(i, end + 1)) and not after_title:
            continue
        stop = tokens[end][2] - (tokens[end][0].endswith("."))
        tail = s[stop : stop + 60]
        score += next((n for cue, n in _BEFORE if cue.search(before)), 0)
        score += max([n for cue, n in _AFTER if cue.match(tail)], default=0)
        rest = _NEXT_FIELD.match(tail)
        if rest and stop + rest.end() in starts:
            score += 2
        if score >= (3 if loose else 2):
            yield a, stop
            done = stop


def _last_of_sentence(text: str) -> bool:
    return len(text) > 3


def _lower_case_name(low: str, tokens: list, i: int, taken: list) -> bool:
    """Whether a lower-case word may begin a name: the next word ends as a family name, or a strong cue precedes."""
    nxt = tokens[i + 1][0] if i + 1 < len(tokens) else ""
    if nxt == "," and i + 2 < len(tokens):
        return tokens[i + 2][0] in GIVEN
    if len(nxt) == 2 and nxt[1] == "." and i + 2 < len(tokens):
        nxt = tokens[i + 2][0]
    return _ends_as_family(nxt.rstrip(".")) or low[max(0, tokens[i][1] - 8) : tokens[i][1]].endswith(("name is ", "name=", "name = ", "name: "))


def _source_end(text: str, s: str, back: list[int], b: int) -> int:
    """Where a find that ends before ``b`` ends in the source: a spelled digit ends with its word."""
    end = back[b - 1] + 1
    if s[b - 1].isdigit() and text[end - 1].isalpha():
        stop = back[b] if b < len(back) else len(text)
        while end < stop and (text[end].isalpha() or text[end] in INVISIBLE):
            end += 1
        while text[end - 1] in INVISIBLE:
            end -= 1
    return end


def _bare_phones(s: str, spelled: list[bool]) -> Iterator[tuple[int, int]]:
    """Phone numbers without the separators of ``_PHONE``, of spelled digits at least in part.

    A run of 10 or 11 spelled digits is one; with figures in it, its parts must
    lie as those of a national number (3-3-4, with 1 before, or any after a 0).
    """
    for m in _FIGURES.finditer(s):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer(r"\d+", m.group())]
        if not any(spelled[i] for a, b in groups for i in range(a, b)):
            continue
        whole = [(a, b) for a, b in groups if b - a in (10, 11) and all(spelled[a:b])]
        if whole and not m.group().startswith("+1"):
            yield from ((m.start() if a == groups[0][0] else a, b) for a, b in whole)
            continue
        digits = "".join(s[a:b] for a, b in groups)
        places, n = set(), 0
        for a, b in groups[:-1]:
            n += b - a
            places.add(n)
        if len(digits) == 10 and (places <= {3, 6} or digits[0] == "0") or len(digits) == 11 and (digits[0] == "1" and places <= {1, 4, 7} or digits[0] == "0"):
            yield m.span()


def _is_street(s: str, m: re.Match) -> bool:
    """Whether number, words and kind of street are an address and not a count of things."""
    ws = re.split(r"[ ’'-]", m.group("street"))
    if any(w.lower() in FUNCTION for w in ws):
        return False
    named = all(w[0].isupper() for w in ws if w)
    upper = m.group().isupper()
    if m.group("kind").lower() in STREET_AMBIGUOUS and not (named and not upper):
        return named and bool(_PLACE_BEFORE.search(s[max(0, m.start() - 12) : m.start()]))
    return named or len(ws) == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) in ``text``, in order, without overlaps.

    NULL and empty text have none.  Where two readings overlap, the first of
    e-mail, address, identity number, phone number, person holds.
    """
    if not text:
        return []
    s, back = normalise(text)
    taken: list[tuple[int, int]] = []
    found: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            found.append((kind, a, b))

    if "@" in s:
        for m in _EMAIL.finditer(s):
            add("EMAIL", *m.span())
    low = s.lower()
    if any(c in low for c in _ROMANCE_CUES):
        for m in _ADDRESS_ROMANCE.finditer(s):
            if (m.group("street") or m.group("name")).lower() not in FUNCTION:
                add("ADDRESS", *m.span())
    if any(c in low for c in _JOINED_CUES):
        for m in _ADDRESS_JOINED.finditer(s):
            add("ADDRESS", *m.span())
    if any(c in low for c in _STREET_CUES):
        for m in _ADDRESS.finditer(s):
            # After a street address, the number is the town's.
            town = any(b < m.start() and s[b : m.start()] == ", " for k, _, b in found if k == "ADDRESS")
            if not town and _is_street(s, m):
                add("ADDRESS", *m.span())
    if _NUMBERS.search(s):
        for m in _ID.finditer(s):
            add("ID_NUMBER", *m.span())
        for m in _LABELLED_ID.finditer(s):
            add("ID_NUMBER", *m.span("id"))
        accounts = [m.span() for m in _ACCOUNT.finditer(s)]
        for m in _PHONE.finditer(s):
            if all(m.end() <= x or m.start() >= y for x, y in accounts):
                add("PHONE", *m.span())
    if back is not None:
        spelled = [c.isdigit() and text[at].isalpha() for c, at in zip(s, back)]
        if any(spelled):
            for span in _bare_phones(s, spelled):
                add("PHONE", *span)
    if _NAME_LIKE.search(s) or "name" in low or any(w.endswith(FAMILY_ENDINGS) and len(w) > 4 for w in _words_of(low)):
        for span in persons(s, list(taken)):
            add("PERSON", *span)
    if back is not None:
        found = [(k, back[a], _source_end(text, s, back, b)) for k, a, b in found]
    return sorted(found, key=lambda x: x[1])


def mask(text: str | None) -> str | None:
    """The text with ``[TYPE]`` in place of every find; NULL stays NULL."""
    if not text:
        return text
    out, end = [], 0
    for kind, a, b in find(text):
        out += [text[end:a], f"[{kind}]"]
        end = b
    return "".join(out) + text[end:]


def find_pii(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per find: (key, pii_type, start_pos, end_pos); positions count characters.

    Repeated rows count once.  The whole text of every row is read; rows with
    NULL or empty text give nothing.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for at, t in enumerate(b.column(1).to_pylist()):
                for kind, x, y in find(t):
                    for col, v in zip(rows, (at, kind, x, y)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int32())), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())], names=["k", "pii_type", "start_pos", "end_pos"])

    kind = dict(df.dtypes)[key]
    out = df.where(F.length(text) > 0).select(key, text).mapInArrow(scan, f"k {kind}, pii_type string, start_pos long, end_pos long")
    return out.distinct().withColumnRenamed("k", key)


def mask_pii(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the text with typed placeholders."""

    @F.pandas_udf("string")
    def masked(s):
        return s.map(mask, na_action="ignore")

    return df.withColumn(out, masked(F.col(text)))
