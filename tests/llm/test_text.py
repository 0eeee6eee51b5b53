import random

import numpy as np
import pytest

from tidewell.llm import leaks, packing, pii, subjects


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("Write to lea984 (at) post(dot)invalid now", "EMAIL", "lea984 (at) post(dot)invalid"),
        ("mailto:belkaz at mail dot example today", "EMAIL", "belkaz at mail dot example"),
        ("mail=samuel.garistad AT mail.example; x", "EMAIL", "samuel.garistad AT mail.example"),
        ("Send to <pаul@corp.test> once", "EMAIL", "pаul@corp.test"),  # a Cyrillic a
        ("Call +44 (0)20 7946 0068 soon", "PHONE", "+44 (0)20 7946 0068"),
        ("tel=(212) 555-0131 ext. 4", "PHONE", "(212) 555-0131"),
        ("ring 030/23125-842 if late", "PHONE", "030/23125-842"),
        ("quoted SSN: 906 22 5116 twice", "ID_NUMBER", "906 22 5116"),
        ("form says social security 931460399, see", "ID_NUMBER", "931460399"),
        ("gave NI number QQ 94 80 42 C for", "ID_NUMBER", "QQ 94 80 42 C"),
        ("Steuer-ID 00 092 365 355 for", "ID_NUMBER", "00 092 365 355"),
        ("on file: id card no. 85765056-K", "ID_NUMBER", "85765056-K"),
        ("Ship it to 169 driftenewood lane.", "ADDRESS", "169 driftenewood lane"),
        ("was left at Coldingentongasse 118 b in", "ADDRESS", "Coldingentongasse 118 b"),
        ("moved to Calle Mossemere 100 in", "ADDRESS", "Calle Mossemere 100"),
        ("met Adrian T. Brenaadottir near", "PERSON", "Adrian T. Brenaadottir"),
        ("Dr. Skereloley, Leon reviewed", "PERSON", "Skereloley, Leon"),
        ("hibistrud met S. Kelinmark today", "PERSON", "S. Kelinmark"),
        ("assigned to daniel pashardottir meanwhile", "PERSON", "daniel pashardottir"),
    ],
)
def test_pii_forms(text, kind, part):
    got = pii.find(text)
    assert [k for k, _, _ in got] == [kind]
    assert text[got[0][1] : got[0][2]] == part


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Contact Jane Smith or Robert Johnson today", [("PERSON", "Jane Smith"), ("PERSON", "Robert Johnson")]),
        ("my name is Wei Zhang", [("PERSON", "Wei Zhang")]),
        ("Maria Garcia", [("PERSON", "Maria Garcia")]),
        ("ask John O'Brien about it", [("PERSON", "John O'Brien")]),
        ("Dear Mr. Okonkwo, thanks", [("PERSON", "Okonkwo")]),
        ("Best regards,\nPriya Raghavan", [("PERSON", "Priya Raghavan")]),
        ("Tom van der Berg wrote this", [("PERSON", "Tom van der Berg")]),
        ("We spoke with Amina Yusuf, who lives at 12 Maple Grove Court.", [("PERSON", "Amina Yusuf"), ("ADDRESS", "12 Maple Grove Court")]),
        ("it stands at 742 evergreen terrace", [("ADDRESS", "742 evergreen terrace")]),
        ("call five five five five five five five five five five", [("PHONE", "five five five five five five five five five five")]),
        ("call five, five, five, zero, one, three, one, two, two, two now", [("PHONE", "five, five, five, zero, one, three, one, two, two, two")]),
        ("write jane\tat\texample.com", [("EMAIL", "jane\tat\texample.com")]),
        ("DE89 3704 0044 0532 0130 00 is the account", []),
        ("Miss Universe and Mr Robot", []),
        ("Place Dr Street", []),
        ("New York is big and San Francisco too", []),
        ("Project Apollo Zenith moved Region Delta Archive", []),
        ("shipped 3 rows drive and 5 close calls", []),
    ],
)
def test_pii_unseen(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find(text)] == want


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("ring two one two five five five zero one three one now", "PHONE", "two one two five five five zero one three one"),
        ("ring one two one two five five five zero one three one.", "PHONE", "one two one two five five five zero one three one"),
        ("call (212) five five five 0131 now", "PHONE", "(212) five five five 0131"),
        ("call two one two 555 0131", "PHONE", "two one two 555 0131"),
        ("call two one two, five five five, zero one three one", "PHONE", "two one two, five five five, zero one three one"),
        ("call 212-555-zero one three one", "PHONE", "212-555-zero one three one"),
        ("ring +1 two one two five five five zero one three one", "PHONE", "+1 two one two five five five zero one three one"),
        ("ring null drei null zwei drei eins zwei fünf acht vier bitte", "PHONE", "null drei null zwei drei eins zwei fünf acht vier"),
        ("his SSN nine zero six two two five one one six, see", "ID_NUMBER", "nine zero six two two five one one six"),
    ],
)
def test_pii_spelled_numbers(text, kind, part):
    got = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in got] == [(kind, part)]
    assert pii.mask(text) == text.replace(part, f"[{kind}]")


@pytest.mark.parametrize("text", ["2125550131 without words", "phase one two 20250101 is open", "one, two, three, four, five, six, seven, eight, nine, zero", "kept near recall 1321. Two empirical 555 0131", "weights 576 and two five", "five five five 0131 is no whole number of ours 7"])
def test_pii_spelled_decoys(text):
    assert pii.find(text) == []


@pytest.mark.parametrize("text", ["Checksum 8215-87549-469984 matches x.", "Ticket REF-2025-021053 blocks y.", "Build 1.50.611 of z failed with E-65560.", "Seen at 2025-07-17 13:21 in a.", "Handle @b pinged @c at noon.", "plus 12 home court", "Offsets 48 38 97 were kept", "Lane 7 of the road map for q is open.", "", None])
def test_pii_decoys(text):
    assert pii.find(text) == []


def test_pii_frames(spark):
    long = "plain words here " * 20000 + "write to a.b@corp.test"
    df = spark.createDataFrame([(1, "mail a@b.org", "x"), (1, "mail a@b.org", "x"), (2, None, "y"), (3, "", "z"), (4, long, "w")], "id long, text string, pii_type string")
    got = sorted(map(tuple, pii.find_pii(df, "id", "text").collect()))
    assert got == [(1, "EMAIL", 5, 12), (4, "EMAIL", len(long) - 13, len(long))]
    masked = {r["id"]: r["m"] for r in pii.mask_pii(df, "text", "m").collect()}
    assert masked[1] == "mail [EMAIL]" and masked[2] is None and masked[3] == ""
    assert pii.find_pii(df.limit(0), "id", "text").count() == 0


def test_suffix_array_and_leaks(spark):
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 300).astype(np.int32)
    sa = leaks.suffix_array(t, 300)
    assert [tuple(t[i:]) for i in sa] == sorted(tuple(t[i:]) for i in range(300))
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(3, 25)))) for i in range(12)]
    docs = []
    for d in range(60):
        ws = r.choices([*vocab, "other"], k=r.randint(0, 40))
        if d % 3 == 0:
            src = r.choice(items)[1].split()
            ws[5:5] = src[r.randint(0, 3) :]
        docs.append((d, ", ".join(ws).upper() if d % 2 else "\n".join(ws)))
    docs += [docs[0], (90, None), (91, "")]
    least = 6
    want = set()
    for d, t in docs:
        w = leaks.words(t)
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for i, x in items:
            v = leaks.words(x)
            if any(tuple(v[j : j + least]) in grams for j in range(len(v) - least + 1)):
                want.add((d, i))
    corpus = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame([*items, (50, None), (51, "short")], "item_id long, text string")
    out = leaks.find_leaks(corpus, tests, min_words=least)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want
    text = dict(docs)
    item = dict(items)
    for m in out.collect():
        a, b = leaks.words(text[m.doc_id]), leaks.words(item[m.item_id])
        assert a[m.doc_word : m.doc_word + m.n_words] == b[m.item_word : m.item_word + m.n_words]
    clean = {r.doc_id for r in leaks.remove_leaked(corpus, out).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    assert leaks.find_leaks(corpus.limit(0), tests).count() == 0 and leaks.find_leaks(corpus, tests.limit(0)).count() == 0


def test_assign_fills_without_splitting():
    rng = np.random.default_rng(4)
    sizes = np.sort(rng.integers(1, 900, 3000))[::-1]
    where, place = packing.assign(sizes, 2048, 1.0, 1 / 2048)
    used = np.bincount(where, sizes)
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.98
    assert len({*zip(where.tolist(), place.tolist())}) == len(sizes)


def test_assign_balances_cost():
    rng = np.random.default_rng(9)
    sizes = np.sort(np.minimum(2048, rng.lognormal(5, 1, 20_000).astype(int) + 1))[::-1]
    where, _ = packing.assign(sizes, 2048, 1.0, 1 / 2048)
    used, cost = np.bincount(where, sizes), np.bincount(where, sizes + sizes * sizes / 2048)
    full = used >= 2000
    assert full.mean() > 0.98 and used.max() <= 2048
    # The quadratic part of a single long document cannot be balanced; the others lie close together.
    others = cost[full & (np.bincount(where) > 3)]
    assert others.std() / others.mean() < 0.15


def test_pack_whole_texts(spark):
    long = "alpha beta gamma " * 2500
    df = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, long), (3, None), (4, ""), (5, "k")], "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS shard")
    got = packing.pack(df).collect()
    n = len(packing.tokenizer(packing.VOCABULARY).encode_ordinary(long))
    two = sorted((r.piece, r.first_token, r.n_tokens) for r in got if r.doc_id == 2)
    assert [p for p, _, _ in two] == list(range(-(-n // 2048))) and sum(t for _, _, t in two) == n
    assert all(f == p * 2048 for p, f, _ in two) and sorted(r.doc_id for r in got if r.doc_id != 2) == [1, 5]
    per = {}
    for r in got:
        per[r.container] = per.get(r.container, 0) + r.n_tokens
    assert max(per.values()) <= 2048
    assert packing.pack(df.limit(0)).count() == 0


def test_subjects(spark):
    r = random.Random(1)
    ws = {s: subjects.SEEDS[s].split()[:12] for s in subjects.SUBJECTS}
    base = "the note was kept near a window while one row moved again".split()
    docs, truth = [], {}
    for d in range(400):
        mine = r.sample(subjects.SUBJECTS, r.choice([0, 1, 1, 2]))
        sents = []
        for s in mine:
            for _ in range(3):
                sents.append(" ".join(r.sample(ws[s], 3) + r.sample(base, 4)))
        for _ in range(4):
            sents.append(" ".join(r.sample(base, 7)))
        if not mine:
            sents.append(" ".join(r.sample(ws["law"], 2) + r.sample(base, 4)))  # one mention only
        r.shuffle(sents)
        docs.append((d, ". ".join(sents) + "."))
        truth[d] = set(mine)
    docs += [docs[0], (900, None), (901, ""), (902, "...")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS subject", "1 AS n")
    got = {}
    rows = subjects.subjects(df).collect()
    for x in rows:
        got.setdefault(x.doc_id, set()).add(x.subject)
    assert len(rows) == sum(map(len, got.values()))
    right = sum(got.get(d, set()) == t for d, t in truth.items())
    assert right >= 0.97 * len(truth)
    assert subjects.subjects(df.limit(0)).count() == 0


def test_word_lookup():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(-(2**31), 2**31, 60_000))
    find = subjects.Lookup(codes)
    assert (find(codes) == np.arange(len(codes))).all()
    other = np.setdiff1d(rng.integers(-(2**31), 2**31, 50_000), codes)
    assert (find(other) == -1).all() and (subjects.Lookup(codes[:0])(other) == -1).all()


def test_subjects_of_each_language(spark):
    r = random.Random(3)
    seeds = {"en": slice(0, 8), "de": slice(-14, -8), "es": slice(-6, None)}
    docs, truth, d = [], {}, 0
    for lang, share in (("en", 200), ("de", 60), ("es", 60)):
        frame = subjects.FUNCTION_WORDS[lang].split()
        for _ in range(share):
            mine = r.sample(subjects.SUBJECTS, r.choice([0, 1, 1, 2]))
            sents = [" ".join(r.sample(subjects.SEEDS[s].split()[seeds[lang]], 2) + r.sample(frame, 6)) for s in mine for _ in range(3)]
            sents += [" ".join(r.sample(frame, 8)) for _ in range(3)]
            r.shuffle(sents)
            docs.append((d, ". ".join(sents) + "."))
            truth[d] = set(mine)
            d += 1
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got: dict = {}
    for x in subjects.subjects(df).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    assert sum(got.get(k, set()) == v for k, v in truth.items()) >= 0.95 * len(truth)
