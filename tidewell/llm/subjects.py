"""Subject areas of documents: anchored non-negative factorization.

The document-term matrix is factored by alternating multiplicative updates
(Kullback-Leibler form).  Each language has its own block of components, since
words of two languages hardly meet in one document: one component a subject,
*anchored* by seed words that may load on no other, and one for what is common
to all texts, anchored by the language's function words.  A document belongs
to the language most of whose function words it has.  Each pass over the
corpus solves the document weights for fixed components and sums, term by
term, what the component update needs; only those sums (a row a term) meet.

The finished components give each sentence its mixture, and a subject counts
for a document where enough sentences are about it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise

# The subjects and seed words (English, German, Spanish) of their components.
SEEDS = {
    "software": "software compiler debugger repository programmer programming codebase middleware frontend subroutine parser framework library deployment refactored debugged compiled deployed deprecated quelltext quellcode übersetzer bibliothek programmierer entwickler programmiersprache kompiliert ausgerollt refaktorisiert compilador depurador repositorio programador programación biblioteca despliegue desplegado compilado depurado",
    "science": "telescope molecule enzyme genome isotope galaxy neutron microscope physics chemistry biology astronomer electron photon laboratory geological quantum sequenced irradiated astronomical teleskop molekül galaxie enzym mikroskop physik chemie biologie forscher isotop labor sequenziert telescopio molécula galaxia enzima microscopio física química biología isótopo hipótesis secuenciado",
    "law": "verdict plaintiff defendant affidavit injunction tribunal statute attorney lawsuit lawyer jurisdiction prosecutor testimony acquitted litigated overruled judicial statutory urteil kläger klausel anwalt angeklagter gericht staatsanwalt klage verklagt freigesprochen richterliche veredicto demandante demandado cláusula abogado juez fiscalía testigo absuelto condenado",
    "sport": "goalkeeper striker referee league stadium tournament football soccer basketball tennis olympic championship athlete marathon dribbled tackled coached offside unbeaten stürmer torwart turnier stadion schiedsrichter mannschaft fußball meisterschaft rückspiel ungeschlagene portero delantero entrenador estadio árbitro torneo fútbol campeonato medalla",
    "health": "patient nurse vaccine surgery therapy insulin symptom hospital physician disease infection medication diagnosed vaccinated prescribed pediatric surgical therapie klinik impfstoff krankenhaus arzt krankheit fieber geimpft behandelt chirurgische paciente cirugía vacuna enfermera hospital médico enfermedad síntoma vacunado clínica",
    "finance": "dividend portfolio mortgage treasury inflation equity investor shareholder creditor loan currency audited refinanced devalued fiscal monetary anleihe kredit dividende aktie zinsen anleger hypothek darlehen währung steuerliche dividendo préstamo hipoteca accionista inversor acreedor bono moneda prestado",
    "cooking": "saucepan skillet recipe garlic flour dough pastry onion oven baking chef kitchen tablespoon butter simmered kneaded whisked caramelised ofen mehl knoblauch zwiebel pfanne teig küche gebacken geknetet würzige horno harina ajo cebolla receta sartén mantequilla cocina horneado amasado",
    "travel": "luggage itinerary hostel airport ferry museum campsite tourist passport suitcase sightseeing backpack boarded hiked toured scenic fähre gepäck flughafen herberge reisepass reiseplan fahrkarte urlaub gewandert malerische aeropuerto equipaje museo albergue pasaporte itinerario billete turista embarcado pintoresca",
}
# Function words of the languages.
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not at from this but are or an were had which one has no if than when after before without why between over under into near",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an wird aus er hat dass sie nach bei um am wie über vor nur warum ohne",
    "es": "de la que el en y los del se las por un para con no una su al lo como más pero sus le ya fue este sin sobre entre cuando porque dio hasta desde nada qué",
}
SUBJECTS, LANGUAGES = list(SEEDS), list(FUNCTION_WORDS)
COMPONENTS = len(SUBJECTS) + 1  # of each language; the last is what is common to all its texts
ROUNDS, INNER, SENTENCE_INNER = 5, 3, 4
STEP = 1.6  # exponent of the update: over-relaxed, which converges in fewer passes
MIN_SHARE = 0.005  # a term that is no seed occurs in at least this share of the documents of its language
ABOUT = 1.2  # words of a subject that make a sentence be about it
MIN_SENTENCES = 2

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?;]+(?=\s|$)|\n\s*\n")


def code(word: str) -> int:
    return zlib.crc32(word.encode()) - (1 << 31)


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence; a word broken over two lines is one word."""
    if not text:
        return []
    return [w for s in _SENTENCE.split(text.lower().replace("-\n", "")) if (w := _WORD.findall(s))]


class Lookup:
    """Places of 32-bit word codes in a list, without a search: -1 where it has none."""

    BITS = 20

    def __init__(self, codes: np.ndarray):
        self.codes = np.append(codes.astype(np.int64), 1 << 40)
        self.tables = []
        left = np.arange(len(codes))
        for turn in range(64):
            if not len(left):
                break
            slot = self._slot(codes[left].astype(np.int64), turn)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << self.BITS, -1, np.int32)
            table[slot[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    def _slot(self, codes: np.ndarray, turn: int) -> np.ndarray:
        return (codes * (0x9E3779B1 + 2 * turn) >> 12) & ((1 << self.BITS) - 1)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        codes = codes.astype(np.int64)
        out = np.full(len(codes), -1, np.int32)
        for turn, table in enumerate(self.tables):
            at = table[self._slot(codes, turn)]
            out = np.where((out < 0) & (self.codes[at] == codes), at, out)
        return out


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of a list column."""
    off = col.offsets.to_numpy()
    return col.flatten().to_numpy(), np.diff(off)


def _languages() -> tuple[np.ndarray, np.ndarray]:
    """Codes of all function words, and for each the languages that have it (word x language)."""
    all_words = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
    return np.array([code(w) for w in all_words]), np.array([[w in ws.split() for ws in FUNCTION_WORDS.values()] for w in all_words], float)


def tokenise(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, lang int, n array<int>: words of each sentence, w array<int>: word codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Codes(dict):
            def __missing__(self, w):
                if len(self) > 500_000:
                    self.clear()
                self[w] = c = code(w)
                return c

        get = Codes().__getitem__
        known, has = _languages()
        lookup = Lookup(known)
        for b in batches:
            n: list[int] = []
            w: list[int] = []
            no, wo = [0], [0]
            for t in b.column(1).to_pylist():
                for s in sentences(t):
                    n.append(len(s))
                    w.extend(map(get, s))
                no.append(len(n))
                wo.append(len(w))
            codes = np.array(w, np.int32)
            at = lookup(codes)
            doc = np.repeat(np.arange(b.num_rows), np.diff(wo))[at >= 0]
            votes = np.stack([np.bincount(doc, has[at[at >= 0], i], b.num_rows) for i in range(len(LANGUAGES))], 1)
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in ((no, pa.array(n, pa.int32())), (wo, pa.array(codes)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes.argmax(1), pa.int32()), *lists], names=["k", "lang", "n", "w"])

    rows = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(key, text)
    return rows.mapInArrow(run, f"k {dict(df.dtypes)[key]}, lang int, n array<int>, w array<int>")


def solve(h: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray, starts: np.ndarray, inner: int) -> np.ndarray:
    """Shares of each matrix entry by component, for fixed components ``h`` (term x component).

    Entries are sorted by row; ``starts`` are the first of each row.
    """
    ht = h[term]
    w = np.ones((len(starts), h.shape[1]), np.float32)
    for i in range(inner):
        c = value / (np.einsum("ij,ij->i", w[row], ht) + 1e-20)
        if i < inner - 1:
            w = w * np.add.reduceat(ht * c[:, None], starts, axis=0) + 0.01
    return w[row] * ht * c[:, None]


def _matrix(row: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, ...]:
    """Entries (row, term, count) of one batch, rows numbered anew, and their row starts."""
    keys, count = np.unique(row.astype(np.int64) * terms + term, return_counts=True)
    r, t = keys // terms, keys % terms
    starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    dense = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(r))))
    return r[starts], dense, t, count.astype(np.float32), starts


class Model:
    """Components of all languages: ``h`` has a row for each (language, word) term."""

    def __init__(self, lang: np.ndarray, codes: np.ndarray, freq: np.ndarray):
        self.lang, self.words = lang, np.unique(codes)
        self.block = np.full((len(LANGUAGES), len(self.words) + 1), -1, np.int64)
        self.block[lang, np.searchsorted(self.words, codes)] = np.arange(len(codes))
        subject = {code(w): s for s, name in enumerate(SUBJECTS) for w in SEEDS[name].split()}
        anchored = np.array([subject.get(c, -1) for c in codes.tolist()], int)
        anchored[np.isin(codes, [code(w) for ws in FUNCTION_WORDS.values() for w in ws.split()])] = COMPONENTS - 1
        self.mask = np.where(anchored[:, None] >= 0, anchored[:, None] == np.arange(COMPONENTS), 1).astype(float)
        h = np.full((len(codes), COMPONENTS), 1e-3)
        h[anchored >= 0] = 1
        h[:, -1] = freq / np.maximum(np.bincount(lang, freq, len(LANGUAGES)), 1)[lang] * 50
        self.set(h * self.mask)

    def set(self, h: np.ndarray) -> None:
        self.mass = np.stack([np.bincount(self.lang, h[:, c], len(LANGUAGES)) for c in range(COMPONENTS)], 1)
        self.h = h / np.maximum(self.mass, 1e-20)[self.lang]

    def update(self, sums: np.ndarray) -> None:
        """The multiplicative update from the summed shares, over-relaxed."""
        old = self.h
        self.set((sums + 1e-4) * self.mask)
        mass = self.mass
        self.set(self.h * np.maximum(self.h / np.maximum(old, 1e-12), 1e-6) ** (STEP - 1) * self.mask)
        self.mass = mass

    def gate(self) -> np.ndarray:
        """Terms of a subject: those whose part outside the common component lies on two subjects at most."""
        p = self.h * self.mass[self.lang]
        p /= p.sum(1, keepdims=True) + 1e-20
        own = p[:, :-1].sum(1)
        two = np.sort(p[:, :-1], axis=1)[:, -2:].sum(1)
        return (own >= 0.2) & (two >= 0.8 * own)

    def terms(self):
        """A function that gives the term of each word code and language, -1 where there is none."""
        lookup, block = Lookup(self.words), self.block
        return lambda codes, lang: block[lang, lookup(codes)]


def sums(w: np.ndarray, lens: np.ndarray, lang: np.ndarray, find, h: np.ndarray) -> np.ndarray | None:
    """What one batch of documents adds to the component update."""
    term = find(w, np.repeat(lang, lens))
    row = np.repeat(np.arange(len(lens)), lens)[term >= 0]
    if not len(row):
        return None
    _, dense, t, value, starts = _matrix(row, term[term >= 0], len(h))
    share = solve(h, dense, t, value, starts, INNER)
    return np.stack([np.bincount(t, share[:, c], len(h)) for c in range(COMPONENTS)], 1)


def fit(tokens: DataFrame, rounds: int = ROUNDS, min_share: float = MIN_SHARE) -> Model:
    """Components of all subjects and languages.

    Every document takes part in every pass.  The terms that reach the driver
    are the seeds and function words, and at most distinct words a document
    over ``min_share`` for each language, whatever the number of documents.
    """
    docs = {r["lang"]: r["n"] for r in tokens.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    least = F.element_at(F.create_map(*[F.lit(x) for i in range(len(LANGUAGES)) for x in (i, max(2.0, min_share * docs.get(i, 0)))]), F.col("lang"))
    fixed = sorted({code(w) for ws in [*SEEDS.values(), *FUNCTION_WORDS.values()] for w in ws.split()})
    freq = tokens.select("lang", F.explode(F.array_distinct("w")).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    found = freq.where((F.col("n") >= least) | F.col("w").isin(fixed)).toPandas().sort_values(["lang", "w"])
    model = Model(found["lang"].to_numpy(np.int64), found["w"].to_numpy(np.int64), found["n"].to_numpy(np.float64))
    v = len(model.lang)
    names = [f"c{i}" for i in range(COMPONENTS)]
    for _ in range(rounds if v else 0):
        current = model.h.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            find = model.terms()
            total = np.zeros((v, COMPONENTS))
            for b in batches:
                part = sums(*_flat(b.column(1)), b.column(0).to_numpy(), find, current)
                if part is not None:
                    total += part
            some = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(total[some, c]) for c in range(COMPONENTS)]], names=["t", *names])

        got = tokens.select("lang", "w").mapInArrow(run, "t int, " + ", ".join(f"{c} double" for c in names)).groupBy("t").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
        total = np.zeros((v, COMPONENTS))
        total[got["t"].to_numpy()] = got[names].to_numpy()
        model.update(total)
    return model


def about(lens: np.ndarray, per_doc: np.ndarray, w: np.ndarray, lang: np.ndarray, find, h: np.ndarray, gate: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, subject, sentences about it) of one batch."""
    k = COMPONENTS - 1
    sent = np.repeat(np.arange(len(lens)), lens)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    term = find(w, lang[doc][sent])
    # Only sentences with a subject word can be about a subject.
    may = np.bincount(sent, np.where(term >= 0, gate[np.maximum(term, 0)], 0), len(lens)) > 0
    use = (term >= 0) & may[sent]
    if not use.any():
        return (np.zeros(0, np.int64),) * 3
    which, dense, t, value, starts = _matrix(sent[use], term[use], len(h))
    share = solve(h, dense, t, value, starts, SENTENCE_INNER)[:, :k] * gate[t][:, None]
    score = np.add.reduceat(share, starts, axis=0)
    best = score.argmax(1)
    hit = score[np.arange(len(best)), best] >= least
    pair, count = np.unique(doc[which[hit]] * k + best[hit], return_counts=True)
    return pair // k, pair % k, count


def classify(tokens: DataFrame, model: Model, least: float = ABOUT) -> DataFrame:
    """(k, subject, n_sentences) for every document and subject with a sentence about it."""
    h, gate = model.h.astype(np.float32), model.gate().astype(np.float32)
    kind = dict(tokens.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = model.terms()
        for b in batches:
            lens, per_doc = _flat(b.column(2))
            doc, subject, count = about(lens, per_doc, _flat(b.column(3))[0], b.column(1).to_numpy(), find, h, gate, least)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(np.array(SUBJECTS, object)[subject], pa.string()), pa.array(count, pa.int32())], names=["k", "subject", "n_sentences"])

    return tokens.mapInArrow(run, f"k {kind}, subject string, n_sentences int")


def subjects(df: DataFrame, key: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """(key, subject, n_sentences) of every document, for its zero or more subjects.

    A subject needs ``min_sentences`` sentences about it.  NULL or empty texts
    and rows with a NULL key have none; repeated rows count once in the
    result; an empty table gives no rows.  The language column is not used.
    """
    tokens = materialise(tokenise(df, key, text), "tokens")
    model = fit(tokens)
    if not len(model.lang):
        return tokens.select(F.col("k").alias(key), F.lit("").alias("subject"), F.lit(0).alias("n_sentences")).limit(0)
    out = classify(tokens, model).where(F.col("n_sentences") >= min_sentences)
    return out.distinct().withColumnRenamed("k", key)
