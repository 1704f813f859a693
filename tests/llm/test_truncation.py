import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pyarrow as pa

from palimpsest.llm import truncation as t

SCHEMA = "doc_id long, text string, source string, captured_at timestamp, words string"


def corpus():
    rnd = random.Random(4)
    names, things, verbs = ["Ann", "Bob", "Cleo", "Dora", "Emil"], ["the old bridge", "the red boat", "the north gate", "the long table", "the small garden"], ["painted", "checked", "closed", "measured", "repaired"]
    sentence = lambda: f"{rnd.choice(names)} {rnd.choice(verbs)} {rnd.choice(things)} before day {rnd.randrange(500)} of the season."
    docs, cut = [], set()
    for i in range(400):
        docs.append([i, " ".join(sentence() for _ in range(rnd.randrange(2, 9))), rnd.choice(["mail", "notes"])])
    for i in range(400, 440):  # a source that cuts at 200 characters
        docs.append([i, " ".join(sentence() for _ in range(8))[:200], "form"])
        cut.add(i)
    for i in range(440, 520):
        docs.append([i, " ".join(sentence() for _ in range(rnd.randrange(1, 4))), "form"])
    for i, end in ((520, "Ann painted the old br"), (521, "Bob measured the long table before day 12 of the")):  # cut in transfer
        docs.append([i, sentence() + " " + end, "mail"])
        cut.add(i)
    whole = " ".join(sentence() for _ in range(30))
    docs += [[530, whole, "notes"], [531, whole[:-90].rsplit(" ", 1)[0].rstrip("."), "mail"], [532, whole.upper(), "mail"]]
    cut.add(531)
    docs += [[533, docs[520][1].replace(" ", " "), "notes"]]  # a copy of a cut text
    cut.add(533)
    docs += [[534, "Ann painted the old bridge before day 7 of the season", "mail"]]  # only the mark is missing
    return docs, cut


def rows(docs):
    return [(i, text, source, datetime(2025, 1, 1), "x") for i, text, source in docs]


def test_finds_planted_cuts(spark):
    docs, cut = corpus()
    extra = [[900, None, "mail"], [901, "", "mail"], [902, " \n ", "mail"], [903, "Ok", None], [904, "Ann painted the red boat before day 3 of the season. " * 2_000, "notes"]]
    judged = {r.doc_id: r for r in t.judged_documents(spark.createDataFrame(rows(docs + extra), SCHEMA)).collect()}
    assert {i for i, r in judged.items() if r.cut} == cut
    assert judged[531].evidence == "copy" and judged[520].evidence == "closing" and judged[400].evidence in ("closing", "ceiling")
    assert not {900, 901, 902} & set(judged) and {903, 904} <= set(judged)


def test_shares_and_empty_table(spark):
    docs, cut = corpus()
    df = spark.createDataFrame(rows(docs + [[900, None, None]]), SCHEMA)
    shares = {r.source: (r.n_documents, r.n_cut) for r in t.cut_shares(df, t.judged_documents(df)).collect()}
    assert shares["form"] == (120, 40) and shares[None] == (1, 0)
    assert t.judged_documents(df.limit(0)).count() == 0


def test_near_copies_match_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(12)]
    texts = list(base)
    for b in base:
        w = b.split()
        texts.append(" ".join(w[: rnd.randrange(40, 60)]))
        w[rnd.randrange(60)] = "other"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, look string")
    shingled = df.mapInArrow(t.shingle_rows, "doc long, words long, shingles array<long>")
    got = {(r.a, r.b) for r in t.near_copies(shingled.select("doc", "shingles")).collect()}
    sets = [{tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)} for x in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert got == want


def test_classes():
    found = [t.word_class(w) for w in t._WORD.findall("Ann paid 12.50 for REQ-4x, see https://a.b/c #tag END 世界")]
    assert found == ["Xx", "paid", "0", "for", "ID", ",", "see", "URL", "TAG", "END", "世", "界"]


def contexts(p, at):
    return {(kind, int(i) if len(at) > 1 else 0, int(h)) for kind, where, hashes in p.contexts(np.array(at)) for i, h in zip(where, hashes, strict=True)}


TEXTS = ["Ann saw it.\n\nKind regards,\nBob Klavik", "世界上的人很多，他们来自各地", "one", "", "x " * 3_000 + "\nsee you", "a b\n" + "y " * 5_000 + "z", "Q\r\n\r\nwe met the old friends", "a b c\n" + "w" * 5_000]


def test_contexts_do_not_depend_on_other_texts():
    together = t.Places(TEXTS)
    for i, text in enumerate(TEXTS):
        alone = t.Places([text])
        own = np.flatnonzero((together.text == i) & ~together.start)
        assert len(own) == len(np.flatnonzero(~alone.start))
        if len(own):
            first = int(own[0]) - int(np.flatnonzero(~alone.start)[0])
            assert contexts(together, own) == {(k, i + first if len(own) > 1 else 0, h) for k, i, h in contexts(alone, np.flatnonzero(~alone.start))}


def test_closing_contexts_are_those_of_the_whole_text():
    flags, found = t.closings(TEXTS)
    for text, marked, broken, small, got in zip(TEXTS, *flags, found.to_pylist(), strict=True):
        p = t.Places([text.rstrip()])
        last = np.flatnonzero(p.last)
        want = {(k, h) for k, _, h in contexts(p, last)} if len(last) and p.nth[last[0]] >= 2 else {(k, h) for k, _, h in contexts(p, last) if k == "1" and small} if len(last) else set()
        assert {(c["kind"], c["context"]) for c in got} == want, text[-40:]
    assert t.closings(["He left.", "He lef\ufffd", "He lef", "世界"])[0] == [[True, False, False, False], [False, True, False, False], [False, False, True, False]]
    assert len(t.closing_part("a b c\n" + "w" * 5_000)) == 5_006 and len(t.closing_part("line of six words is here\n" * 1_000)) < 5_000


def family(n: int):
    """``n`` texts of one template with their own fields, and a cut copy of each: all share buckets, few are near another member."""
    rnd = random.Random(8)
    template = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(n):
        w = list(template)
        for k in (100, 106, 112, 118):
            w[k] = f"f{rnd.randrange(10_000)}x{i}"
        texts.append(" ".join(w))
        texts.append(" ".join(w[: rnd.randrange(108, 116)]))
    return texts


def test_pairs_of_a_large_family_match_brute_force(spark, monkeypatch):
    texts = family(200)
    sets = [[tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)] for x in texts]
    held = [set(s) for s in sets]
    after = lambda s, o: len(o) - o.index(s[-2]) - 2 if s[-2] in o else None
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), t.shingled(texts)[1]], names=["doc", "words", "shingles"])
    bands = defaultdict(set)
    for rows_ in t.band_rows(iter([batch])):
        for doc, band in zip(rows_["doc"].to_pylist(), rows_["band"].to_pylist(), strict=True):
            bands[doc].add(band)
    want = {}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            n = len(held[i] & held[j])
            if bands[i] & bands[j] and n >= 0.8 * (len(held[i]) + len(held[j]) - n):
                want[i, j] = (after(sets[i], sets[j]), after(sets[j], sets[i]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, look string")
    shingled = df.mapInArrow(t.shingle_rows, "doc long, words long, shingles array<long>").select("doc", "shingles")
    for texts_of_block in (1_000, 70):  # one block a bucket, and several
        monkeypatch.setattr(t, "BLOCK_TEXTS", texts_of_block, raising=False)
        got = [((r.a, r.b), (r.a_short, r.b_short)) for r in t.near_copies(shingled).collect()]
        assert len(got) == len(set(got)) and dict(got) == want
