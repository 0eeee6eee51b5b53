"""Full-text search: tokenizer, stemmer, tsvector, tsquery, match and rank.

A tsvector is array<struct<lex string, pos array<int>>>, sorted by lexeme; a
position has its weight in the bits above the 14 of the place (D is 0, A is 3).
A tsquery is parsed on the driver and compiled to a Column over it, so that
matching and ranking stay in the JVM; only tokenizing runs in Python.
``Index`` stores the postings of a table once, so that a query reads the few
lexemes it names and tokenizes nothing.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.datetime import let
from tidewell.session import join_checked, materialise

MAX_POSITION = 16_383
TSVECTOR = "array<struct<lex:string,pos:array<int>>>"
# English stop words and rank weights.
STOP = frozenset("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())
WEIGHT = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
_LETTERS = "DCBA"  # by the number in a position's upper bits

_WORD = re.compile(r"[^\W_]+(?:['’.][^\W\d_]+)*")
_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(w: str) -> tuple[int, int]:
    """Starts of the regions after the first and second vowel-consonant change."""

    def after(at: int) -> int:
        for i in range(at + 1, len(w)):
            if w[i] not in _VOWEL and w[i - 1] in _VOWEL:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWEL and w[1] not in _VOWEL
    return len(w) > 2 and w[-3] not in _VOWEL and w[-2] in _VOWEL and w[-1] not in _VOWEL + "wxY"


# Exceptional forms and suffix tables of the published algorithm.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEEP_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """English (Porter2) stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.lstrip("'")
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = re.sub(r"(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
        w = w[:-1]
    if w in _KEEP_1A:
        return w
    # 1b
    if w.endswith(("eedly", "eed")):
        s = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if any(c in _VOWEL for c in w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLE):
                        w = w[:-1]
                    elif _short(w) and r1 >= len(w):
                        w += "e"
                break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    # 2
    for s, new in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w.endswith("logi") else w
                elif s == "li":
                    w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(s)] + new
            break
    # 3
    for s, new in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + new
            break
    # 4
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def words(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def lexemes(text: str | None, config: str = "english") -> list[tuple[str, int]]:
    """(lexeme, position from 1); stop words are left out but take a position."""
    out = []
    for i, w in enumerate(words(text or ""), 1):
        p = min(i, MAX_POSITION)
        if config == "simple":
            out.append((w, p))
        elif w not in STOP:
            out.append((stem(w), p))
    return out


def to_tsvector(text: Column, config: str = "english") -> Column:
    @F.pandas_udf(TSVECTOR)
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            by: dict[str, list[int]] = {}
            for lex, p in lexemes(t, config):
                by.setdefault(lex, []).append(p)
            return sorted(by.items())

        return pd.Series([one(t) for t in s], index=s.index, dtype=object)

    return run(text)


# Query trees: ("lex", text, prefix, weights) ("not", q) ("and", a, b) ("or", a, b) ("phrase", a, b, distance)
def to_tsquery(text: str, config: str = "english"):
    """``& | ! <-> <N> :AB * ( )``; precedence | < & < ! < phrase."""
    toks = re.findall(r"<->|<\d+>|[&|!()]|'(?:[^']|'')*'(?::[A-Da-d*]+)?|[^\s&|!()<>']+", text)
    at = 0

    def peek():
        return toks[at] if at < len(toks) else None

    def either():
        nonlocal at
        a = both()
        while peek() == "|":
            at += 1
            a = _join("or", a, both())
        return a

    def both():
        nonlocal at
        a = negated()
        while peek() == "&":
            at += 1
            a = _join("and", a, negated())
        return a

    def negated():
        nonlocal at
        if peek() == "!":
            at += 1
            q = negated()
            return None if q is None else ("not", q)
        return phrase()

    def phrase():
        nonlocal at
        a = atom()
        while (t := peek()) and t.startswith("<"):
            at += 1
            n = 1 if t == "<->" else int(t[1:-1])
            b = negated() if peek() == "!" else atom()
            a = b if a is None else a if b is None else ("phrase", a, b, n)
        return a

    def atom():
        nonlocal at
        t = peek()
        if t is None or t in "&|)":
            raise ValueError(f"bad tsquery {text!r}")
        at += 1
        if t == "(":
            q = either()
            if peek() != ")":
                raise ValueError(f"bad tsquery {text!r}")
            at += 1
            return q
        m = re.fullmatch(r"(?:'((?:[^']|'')*)'|([^:]+))(?::([A-Da-d*]+))?", t)
        raw, flags = (m.group(1) or m.group(2) or "").replace("''", "'"), (m.group(3) or "").upper()
        q = None
        for w in words(raw):
            if config != "simple" and w in STOP:
                continue
            leaf = ("lex", w if config == "simple" else stem(w), "*" in flags, flags.replace("*", ""))
            q = leaf if q is None else ("phrase", q, leaf, 1)
        return q

    if not toks:
        return None
    q = either()
    if at < len(toks):
        raise ValueError(f"bad tsquery {text!r}")
    return q


def _join(kind, a, b):
    return b if a is None else a if b is None else (kind, a, b)


def plainto_tsquery(text: str, config: str = "english"):
    q = None
    for lex, _ in lexemes(text, config):
        q = _join("and", q, ("lex", lex, False, ""))
    return q


def phraseto_tsquery(text: str, config: str = "english"):
    q, last = None, 0
    for lex, p in lexemes(text, config):
        leaf = ("lex", lex, False, "")
        q = leaf if q is None else ("phrase", q, leaf, p - last)
        last = p
    return q


def websearch_to_tsquery(text: str, config: str = "english"):
    """Words are AND-ed; ``"..."`` is a phrase, ``or`` an alternative, ``-`` a negation."""
    q, alt = None, None
    pending_or = False
    for neg, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if not quoted and word.lower() == "or" and not neg:
            pending_or = q is not None
            continue
        part = phraseto_tsquery(quoted, config) if quoted else phraseto_tsquery(word, config)
        if part is None:
            continue
        part = ("not", part) if neg else part
        if pending_or:
            alt, q, pending_or = _join("or", alt, q), part, False
        else:
            q = _join("and", q, part)
    return _join("or", alt, q)


def numnode(q) -> int:
    return 0 if q is None else 1 if q[0] == "lex" else 1 + sum(numnode(x) for x in q[1:] if isinstance(x, tuple))


def _place(p: Column) -> Column:
    return p.bitwiseAND(F.lit(MAX_POSITION))


def _weight(p: Column) -> Column:
    return F.element_at(F.array(*[F.lit(WEIGHT[x]) for x in _LETTERS]), F.shiftright(p, 14) + 1)


def _positions(v: Column, leaf) -> Column:
    """Positions of a query word, of the weights it asks for; those of a prefix come once, in order."""
    _, lex, prefix, flags = leaf
    hit = (lambda e: e["lex"].startswith(lex)) if prefix else (lambda e: e["lex"] == lex)
    out = F.flatten(F.transform(F.filter(v, hit), lambda e: e["pos"]))
    if flags:
        out = F.filter(out, lambda p: F.shiftright(p, 14).isin([_LETTERS.index(x) for x in flags]))
    return F.array_sort(F.array_distinct(out)) if prefix else out


def _ends(v: Column, q) -> Column:
    """Positions at which a phrase ends."""
    if q[0] == "lex":
        return _positions(v, q)
    if q[0] == "phrase":
        a, b = _ends(v, q[1]), _ends(v, q[2])
        n = q[3]
        return let(a, lambda xs: F.filter(b, lambda p: F.exists(xs, lambda x: _place(x) + n == _place(p))))
    raise ValueError("a phrase holds only words")


def overflowed(v: Column) -> Column:
    """Whether words beyond the last position were put there, so that phrases cannot be told."""
    return F.aggregate(v, F.lit(0), lambda a, e: a + F.size(F.filter(e["pos"], lambda p: _place(p) == MAX_POSITION))) > 1


def match(v: Column, q, over: Column | None = None) -> Column:
    """``v @@ q``; an empty query matches nothing, and a lexeme without positions (``strip``) is not found.

    A phrase over a vector with more words than positions is an error.
    """
    if q is None:
        return F.lit(False)
    kind = q[0]
    if kind == "lex":
        return F.size(_positions(v, q)) > 0
    if kind == "not":
        return ~match(v, q[1], over)
    if kind == "phrase":
        bad = F.raise_error(F.lit("tsvector position overflow: phrases cannot be told")).cast("boolean")
        return F.when(overflowed(v) if over is None else over, bad).otherwise(F.size(_ends(v, q)) > 0)
    a, b = match(v, q[1], over), match(v, q[2], over)
    return a & b if kind == "and" else a | b


def _leaves(q) -> list:
    """Words of a query that are not negated."""
    if q is None or q[0] == "not":
        return []
    return [q] if q[0] == "lex" else [x for p in q[1:] if isinstance(p, tuple) for x in _leaves(p)]


def _words_of(q) -> list:
    """All words of a query."""
    return [] if q is None else [q] if q[0] == "lex" else [x for p in q[1:] if isinstance(p, tuple) for x in _words_of(p)]


def _normed(rank: Column, v: Column, norm: int, sizes: tuple[Column, Column] | None = None) -> Column:
    n, u = sizes or (F.aggregate(v, F.lit(0), lambda a, e: a + F.size(e["pos"])), F.size(v))
    n, u = n.cast("double"), u.cast("double")
    for bit, least, size, by in ((1, 1, n, 1 + F.log(n)), (2, 0, n, n), (8, 0, u, u), (16, 1, u, 1 + F.log(u))):
        if norm & bit:
            rank = F.when(size > least, rank / by).otherwise(rank)
    return rank / (rank + 1) if norm & 32 else rank


def ts_rank(v: Column, q, norm: int = 0, sizes: tuple[Column, Column] | None = None) -> Column:
    """Sum over the query's words of their positions' weights x (1 + ln(1 + tf)); negated words are left out."""
    rank = F.lit(0.0)
    for leaf in _leaves(q):
        at = _positions(v, leaf)
        rank = rank + F.aggregate(at, F.lit(0.0), lambda a, p: a + _weight(p)) * (1 + F.log(1.0 + F.size(at)))
    return _normed(rank, v, norm, sizes)


def ts_rank_cd(v: Column, q, norm: int = 0, sizes: tuple[Column, Column] | None = None) -> Column:
    """Best cover: summed weights inside a window that has all the query's words, over the window's length."""
    leaves = _leaves(q)
    weight = [WEIGHT[x] for x in _LETTERS]

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        def one(at):
            if at is None or not len(at) or any(not len(x) for x in at):
                return 0.0
            hits = sorted((int(p) & MAX_POSITION, i, int(p) >> 14) for i, ps in enumerate(at) for p in ps)
            seen = [0] * len(at)
            best, lo, covered, total = 0.0, 0, 0, 0.0
            for p, i, w in hits:
                covered += not seen[i]
                seen[i] += 1
                total += weight[w]
                while covered == len(at):
                    best = max(best, total / (p - hits[lo][0] + 1))
                    _, j, x = hits[lo]
                    seen[j] -= 1
                    covered -= not seen[j]
                    total -= weight[x]
                    lo += 1
            return best

        return s.map(one)

    rank = run(F.array(*[_positions(v, x) for x in leaves])) if leaves else F.lit(0.0)
    return _normed(rank, v, norm, sizes)


def setweight(v: Column, letter: str, lexemes_: list[str] | None = None) -> Column:
    """The vector with every position (or those of some lexemes) of one weight."""
    if letter.upper() not in _LETTERS or len(letter) != 1:
        raise ValueError(f"unknown weight {letter!r}")
    bits = _LETTERS.index(letter.upper()) << 14

    def one(e: Column) -> Column:
        new = F.transform(e["pos"], lambda p: _place(p).bitwiseOR(F.lit(bits)))
        return F.struct(e["lex"].alias("lex"), (new if lexemes_ is None else F.when(e["lex"].isin(lexemes_), new).otherwise(e["pos"])).alias("pos"))

    return F.transform(v, one)


def concat(a: Column, b: Column) -> Column:
    """``||``: the lexemes of both, with all their positions."""

    def merged(both: Column) -> Column:
        # A lexeme occurs once in each vector, so equal ones are neighbours: the second joins the first.
        same = lambda i, e: F.coalesce(F.get(both, i)["lex"] == e["lex"], F.lit(False))

        def joined(e: Column, i: Column) -> Column:
            more = F.when(same(i + 1, e), F.get(both, i + 1)["pos"]).otherwise(F.array().cast("array<int>"))
            return F.struct(e["lex"].alias("lex"), F.array_sort(F.array_union(e["pos"], more)).alias("pos"), ((i > 0) & same(i - 1, e)).alias("second"))

        return F.transform(F.filter(F.transform(both, joined), lambda e: ~e["second"]), lambda e: F.struct(e["lex"].alias("lex"), e["pos"].alias("pos")))

    return let(F.array_sort(F.concat(a, b)), merged)


def ts_lexize(word: Column, config: str = "english") -> Column:
    """The lexeme of one word, NULL for a stop word."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            w = unicodedata.normalize("NFKC", t).lower()
            return w if config == "simple" else None if w in STOP else stem(w)

        return s.map(one, na_action="ignore")

    return run(word)


@dataclass(frozen=True)
class Index:
    """Stored postings (lex, k, pos), ordered by lexeme and key, and the sizes (k, n, u) of the documents."""

    postings: DataFrame
    docs: DataFrame
    config: str


def build_index(df: DataFrame, key: str, text: str, config: str = "english") -> Index:
    """Tokenize every text once and store its postings.

    They are range-partitioned by lexeme and key, so that a scan for a few
    lexemes reads few row groups and a lexeme of many documents spans many
    files.  NULL texts and keys are in no index; a repeated key must not occur
    with different texts.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str | None] = {}

        def lexeme(w: str) -> str | None:
            if w not in cache:
                if len(cache) > 500_000:
                    cache.clear()
                cache[w] = w if config == "simple" else None if w in STOP else stem(w)
            return cache[w]

        for b in batches:
            lex: list[str | None] = []
            row: list[int] = []
            pos: list[list[int]] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                by: dict[str, list[int]] = {}
                n = 0
                for n, w in enumerate(words(t), 1):  # noqa: B007
                    x = lexeme(w)
                    if x is not None:
                        by.setdefault(x, []).append(min(n, MAX_POSITION))
                lex += [None, *by]
                row += [i] * (len(by) + 1)
                pos += [[sum(map(len, by.values())), len(by), n], *by.values()]
            yield pa.RecordBatch.from_arrays([pa.array(lex, pa.string()), b.column(0).take(pa.array(row, pa.int32())), pa.array(pos, pa.list_(pa.int32()))], names=["lex", "k", "pos"])

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    stage = materialise(rows.mapInArrow(run, f"lex string, k {kind}, pos array<int>"), "lexemes")
    postings = materialise(stage.where("lex IS NOT NULL").dropDuplicates(["lex", "k"]).repartitionByRange("lex", "k").sortWithinPartitions("lex", "k"), "postings")
    docs = materialise(stage.where("lex IS NULL").select("k", F.col("pos")[0].alias("n"), F.col("pos")[1].alias("u"), (F.col("pos")[2] > MAX_POSITION).alias("over")).dropDuplicates(["k"]), "sizes")
    return Index(postings, docs, config)


def _matches_nothing(q) -> bool:
    """Whether a query matches a vector without any of its words."""
    if q is None or q[0] in ("lex", "phrase"):
        return False
    if q[0] == "not":
        return not _matches_nothing(q[1])
    a, b = _matches_nothing(q[1]), _matches_nothing(q[2])
    return a and b if q[0] == "and" else a or b


def _has_phrase(q) -> bool:
    return q is not None and q[0] != "lex" and (q[0] == "phrase" or any(_has_phrase(x) for x in q[1:] if isinstance(x, tuple)))


def search(index: Index, q, sizes: bool = False) -> DataFrame:
    """(k, v, n, u, over) of the matching documents; ``v`` has the query's lexemes only.

    Only the postings of the query's words are read.  The documents' sizes are
    joined where a phrase, a norm (``sizes``) or a query that documents without
    its words match (``!court``) needs them.
    """
    asked = F.lit(False)
    for _, lex, prefix, _ in dict.fromkeys(_words_of(q)):
        asked = asked | (F.col("lex").startswith(lex) if prefix else F.col("lex") == lex)
    v = F.array_sort(F.collect_list(F.struct("lex", "pos"))).alias("v")
    found = index.postings.where(asked).groupBy("k").agg(v)
    none = F.array().cast(TSVECTOR)
    if _matches_nothing(q):
        found = index.docs.join(found, "k", "left").withColumn("v", F.coalesce("v", none))
    elif sizes or _has_phrase(q):
        found = join_checked(index.docs, found, "k")
    else:
        found = found.select("k", "v", *[F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("u", "int"), ("over", "boolean"))])
    return found.where(match(F.col("v"), q, F.col("over"))) if q is not None else found.where(F.lit(False))


def search_count(index: Index, q) -> DataFrame:
    """COUNT(*) of the matching documents (one row: n)."""
    return search(index, q).agg(F.count("*").alias("n"))


def search_ranked(index: Index, q, k: int, norm: int = 0, cover: bool = False) -> DataFrame:
    """(k, rank) of the first ``k`` documents by rank, equal ranks by key."""
    found = search(index, q, sizes=norm & 31 > 0)
    rank = (ts_rank_cd if cover else ts_rank)(F.col("v"), q, norm, (F.col("n"), F.col("u")))
    return found.select("k", rank.alias("rank")).orderBy(F.col("rank").desc(), "k").limit(k)


def ts_headline(text: Column, q, config: str = "english", start: str = "<b>", stop: str = "</b>") -> Column:
    """The text with the query's words marked."""
    leaves = {x[1] for x in _leaves(q)}

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def mark(m):
            w = m.group().lower()
            lex = w if config == "simple" else stem(w)
            hit = (config == "simple" or w not in STOP) and (lex in leaves or w in leaves)
            return f"{start}{m.group()}{stop}" if hit else m.group()

        return s.map(lambda t: _WORD.sub(mark, t), na_action="ignore")

    return run(text)


def strip(v: Column) -> Column:
    return F.transform(v, lambda e: F.struct(e["lex"].alias("lex"), F.array().cast("array<int>").alias("pos")))


def query_text(q) -> str:
    """A query as text."""
    if q is None:
        return ""
    if q[0] == "lex":
        return "'" + q[1].replace("'", "''") + "'" + (":" + "*" * q[2] + q[3] if q[2] or q[3] else "")
    if q[0] == "not":
        return f"!{query_text(q[1])}" if q[1][0] == "lex" else f"!( {query_text(q[1])} )"
    sign = {"and": "&", "or": "|"}.get(q[0]) or ("<->" if q[3] == 1 else f"<{q[3]}>")
    return " ".join([*(f"( {query_text(x)} )" if x[0] in ("and", "or", "phrase") and x[0] != q[0] else query_text(x) for x in q[1:2]), sign, *(f"( {query_text(x)} )" if x[0] in ("and", "or", "phrase") and x[0] != q[0] else query_text(x) for x in q[2:3])])


def length(v: Column) -> Column:
    return F.size(v).cast("long")
