"""The chunker: offsets worked out by hand, and properties of random layouts."""

import random

from quillspan.operators import chunking as C


def laid_out(blocks):
    text, spans = "", []
    for kind, excerpt, slide in blocks:
        if text:
            text += "\n\n"
        spans.append((kind, slide, len(text), len(text) + len(excerpt)))
        text += excerpt
    return text, spans


#: One character a token: chunks of up to 20, at most 26, five of overlap at most, three at least.
SMALL = C.Sizes(target=20, hard=26, overlap=6, split_above=24, least=5, piece_least=10, chars=1)


def test_offsets_worked_out_by_hand():
    blocks = [("heading", "Alpha", None), ("paragraph", "one two three", None), ("paragraph", "four five six", None), ("heading", "Beta", None), ("paragraph", "seven eight", None)]
    text, spans = laid_out(blocks)
    assert [(a, b) for _, _, a, b in spans] == [(0, 5), (7, 20), (22, 35), (37, 41), (43, 54)]
    # "three" is carried over; the heading begins bare.
    assert C.pack(text, spans, SMALL) == [(0, 20), (15, 35), (37, 54)]
    # A tail of one character joins the chunk before it; one of ten stays, with "eight" carried over.
    assert C.pack(*laid_out([*blocks, ("heading", "Z", None)]), SMALL)[-1] == (37, 57)
    assert C.pack(*laid_out([*blocks, ("paragraph", "end", None)]), SMALL)[-2:] == [(37, 54), (49, 59)]


def test_oversized_spans_are_cut_at_their_best_boundary():
    # A line break at 12 wins over the later spaces; what is left fits.
    text, spans = laid_out([("paragraph", "aaaa bbbb cc\ndddd eeee ffff gg", None)])
    assert [(u.start, u.end) for u in C.units(text, spans, SMALL)] == [(0, 12), (13, 30)]
    # Without any white space the cut is hard.
    text, spans = laid_out([("paragraph", "x" * 45, None)])
    assert [(u.start, u.end) for u in C.units(text, spans, SMALL)] == [(0, 20), (20, 40), (40, 45)]


def test_slides_begin_bare_and_stay_together():
    blocks = [("slide_text", "first slide", 1), ("slide_notes", "note", 1), ("slide_text", "second one", 2)]
    text, spans = laid_out(blocks)
    assert C.pack(text, spans, SMALL) == [(0, 17), (19, 29)]


def test_random_layouts_hold_the_contract():
    rng = random.Random(5)
    sizes = C.Sizes(40, 50, 6, 44, 10, 20)
    for _ in range(200):
        blocks = []
        for _ in range(rng.randint(1, 18)):
            kind = rng.choice(["heading", "paragraph", "slide_text", "slide_notes"])
            words = " ".join(rng.choice(["a", "bcd", "efghij.", "k\n", "l\n\nm", "é\U0001f600"]) for _ in range(rng.randint(1, 120)))
            blocks.append((kind, words.strip() or "x", rng.randint(1, 4) if kind.startswith("slide") else None))
        text, spans = laid_out(blocks)
        chunks = C.pack(text, spans, sizes)
        covered, before = 0, (-1, -1)
        for a, b in chunks:
            assert a > before[0] and b > before[1]
            assert sizes.tokens(b - a) <= sizes.hard
            assert not text[a].isspace() and not text[b - 1].isspace()
            assert not text[covered:a].strip()
            covered, before = max(covered, b), (a, b)
        assert not text[covered:].strip()


def test_nothing_visible_gives_no_chunk():
    assert C.pack("  \n ", [("paragraph", None, 0, 4)]) == []
    assert C.pack("", []) == []


def test_what_ranges_leave_uncovered(spark):
    from quillspan.operators.intervals import uncovered

    rng = random.Random(9)
    base, covers, want = [], [], []
    for k in range(30):
        own = sorted(rng.sample(range(60), 4))
        base += [(k, own[0], own[1]), (k, own[2], own[3])]
        held = [sorted(rng.choices(range(-5, 70), k=2)) for _ in range(rng.randrange(5))]
        covers += [(k, a, b) for a, b in held]
        for s, e in ((own[0], own[1]), (own[2], own[3])):
            free = [i for i in range(s, e) if not any(a <= i < b for a, b in held)]
            want += [(k, i, next(j + 1 for j in range(i, e) if j + 1 not in free)) for i in free if i - 1 not in free]
    schema = "k int, start int, end int"
    got = uncovered(spark.createDataFrame(base, schema), spark.createDataFrame(covers, schema), ["k"], 7)
    assert sorted((r.k, r.start, r.end) for r in got.collect()) == sorted(want)


def test_every_violation_is_told(spark):
    import hashlib

    text = "one two.\n\nthree four.\n\nfive"
    spans = [("p", None, 0, 8), ("p", None, 10, 21), ("p", None, 23, 27)]

    def row(key, n, a, b, first, last, said=None, tokens=None):
        said = text[a:b] if said is None else said
        return (key, n, a, b, first, last, -(-(b - a) // 4) if tokens is None else tokens, hashlib.sha256(said.encode()).hexdigest())

    fine = [(0, 0, 21, 0, 1), (1, 10, 27, 1, 2)]
    cases = {
        "fine": [row(1, *c) for c in fine],
        "not_numbered": [row(1, 0, 0, 21, 0, 1), row(1, 2, 10, 27, 1, 2)],
        "not_increasing": [row(1, 0, 0, 27, 0, 2), row(1, 1, 10, 27, 1, 2)],
        "not_its_text": [row(1, *fine[0], said="other"), row(1, *fine[1])],
        "too_large": [row(1, *fine[0], tokens=7), row(1, *fine[1])],
        "white_edges": [row(1, 0, 0, 22, 0, 1), row(1, 1, 10, 27, 1, 2)],
        "wrong_spans": [row(1, 0, 0, 21, 0, 2), row(1, 1, 10, 27, 1, 2)],
        "uncovered_text": [row(1, 0, 0, 8, 0, 0), row(1, 1, 10, 21, 1, 1)],
    }
    schema = "k int, chunk_ordinal int, start_offset long, end_offset long, first_span int, last_span int, estimated_tokens long, text_hash string"
    version = spark.createDataFrame([(1, text, spans)], "k int, text string, spans array<struct<kind:string,slide:int,start:int,end:int>>")
    for problem, rows in cases.items():
        got = [r.problem for r in C.violations(spark.createDataFrame(rows, schema), version, "k").collect()]
        assert got == ([] if problem == "fine" else [problem]), problem
