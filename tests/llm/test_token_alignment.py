import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rolloom.llm.queries import ALIGNED, op11_aligned_tokens
from rolloom.llm.token_alignment import Aligner, align, per_document

NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Whole:
    """Both tokenizers over whole texts, and links by comparing byte ranges."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(ALIGNED.a), SentencePieceProcessor(model_file=ALIGNED.b)
        self.a.encode_special_tokens = True
        # the usual way to write this table: printable bytes first, then the rest from 256 on
        shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = [*map(chr, shown), *(chr(256 + i) for i in range(256 - len(shown)))]
        self.byte = dict(zip(letters, [*shown, *(b for b in range(256) if b not in shown)]))

    def pieces(self, text):
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            yield i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, text):
        """(ids of A, ids of B, groups, links) or None."""
        if not text:
            return None
        whole = (" " + text).encode()
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = list(self.pieces(text))
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return None
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, token in side:
                out.append((i, at, at + len(token)))
                at += len(token)
            spans.append(out)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, at = [], [0, 0]
        for end in ends:
            ids = [[], []]
            for k, side in enumerate(spans):
                while at[k] < len(side) and side[at[k]][2] <= end:
                    ids[k].append(str(side[at[k]][0]))
                    at[k] += 1
            groups.append("|".join(map(",".join, ids)))
        links, j = [], 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        return len(a), len(b), groups, links


def brute(rows):
    whole = Whole()
    seen = {text: whole(text) for _, text in rows}
    held = Counter(pair for _, text in rows if seen[text] for pair in set(seen[text][3]))
    highest = defaultdict(int)
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    out = []
    for i, text in rows:
        if not seen[text]:
            out.append((i, *[0] * 6, ""))
            continue
        n_a, n_b, groups, links = seen[text]
        best = sum(held[x] == highest[x[0]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, n_a, n_b, len(groups), len(links), best, sum(held[x] for x in links), digest))
    return sorted(out, key=str), held


def test_whole_table_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    result = op11_aligned_tokens(spark, sf_dir)
    assert result.columns == ["doc_id", *NUMBERS, "groups_sha256"]
    assert sorted(map(tuple, result.collect()), key=str) == brute(rows)[0]


def test_edges(rows):
    copy = "The quick brown fox, naïve café — 12,345 times"
    data = [(1, copy, "x")] * 12 + [(i, copy, "y") for i in range(20, 60)]
    data += [
        (2, None, "x"), (3, "", "x"), (None, "one two", "x"), (None, None, "x"), (4, " ", "x"), (5, "  a  b \n c\t", "x"),
        (6, "<|endoftext|> and <s> </s> <unk> <0x0A>", "x"), (7, "a▁b plain words", "x"), (8, "\x00 \x85 nul", "x"),
        (9, "word " * 30000 + "end", "x"), (10, "日本語のテキスト 😀😀 é", "x"), (11, "abc" * 9000, "x"),
    ]
    df = rows("doc_id long, text string, key string", data)
    for block_bytes in (50, 1 << 24):
        found = align(df, "text", ALIGNED, block_bytes)
        groups = {r.key: r.groups for r in found.texts.collect()}
        made = per_document(df, "doc_id", "text", found.measures).collect()
        assert len(made) == len(data)
        expected, held = brute([r[:2] for r in data])
        numbers = sorted([(r.doc_id, *(r[n] or 0 for n in NUMBERS)) for r in made], key=str)
        assert numbers == sorted([r[:-1] for r in expected], key=str)
        digests = {hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups.values()}
        assert digests == {r[-1] for r in expected}
        assert {(r.a, r.b): r.documents for r in found.pairs.collect()} == held
    empty = hashlib.sha256("a▁b plain words".encode()).hexdigest()
    assert groups[empty] == ""


def test_empty_table(rows):
    df = rows("doc_id long, text string", [])
    found = align(df, "text", ALIGNED)
    assert [part.count() for part in found] == [0, 0, 0]
    assert per_document(df, "doc_id", "text", found.measures).count() == 0
    nulls = rows("doc_id long, text string", [(1, None), (1, "")])
    assert per_document(nulls, "doc_id", "text", align(nulls, "text", ALIGNED).measures).count() == 2


@pytest.fixture(scope="module")
def aligner():
    return Aligner(ALIGNED)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n  ab.,'s12é\x1c　​<>|"), st.characters(codec="utf-8")), min_size=1, max_size=40))
def test_segments_have_the_tokens_of_the_whole(aligner, text):
    parts = aligner.learn(list(dict.fromkeys(aligner.cut(text))))
    found = dict(zip(dict.fromkeys(aligner.cut(text)), parts))
    expected = Whole.__call__(WHOLE, text)
    if None in found.values():
        assert expected is None or "".join(aligner.cut(text)) != text
        return
    whole = [found[s] for s in aligner.cut(text)]
    assert expected is not None and ";".join(expected[2]) == ";".join(s.groups for s in whole)
    many = len(aligner.b_bytes)
    assert expected[3] == [divmod(p, many) for s in whole for p in np.frombuffer(s.pairs, np.int64).tolist()]


WHOLE = Whole()


def test_text_is_cut_where_tokens_part(aligner):
    assert aligner.parts
    assert aligner.cut("one two  three \n four ") == ["one", "two  three \n four "]


def test_segments_are_encoded_together(aligner):
    calls = {"a": [], "b": []}

    class Counting:
        def __init__(self, side, whole):
            self.side, self.whole = side, whole

        def encode_batch_fast(self, texts, **options):
            calls[self.side] += texts
            return self.whole.encode_batch_fast(texts, **options)

        def encode(self, texts, **options):
            calls[self.side] += texts
            return self.whole.encode(texts, **options)

    segments = [f"word{i}, no{i * i}ne" for i in range(3000)]
    expected = [aligner.whole(s) for s in segments]
    assert None not in expected
    fresh = Aligner(ALIGNED)
    fresh.a, fresh.b = Counting("a", fresh.a), Counting("b", fresh.b)
    assert fresh.learn(segments) == expected
    assert len(calls["a"]) <= 30 and len(calls["b"]) <= 30


def test_odd_segments_among_others(aligner):
    odd = ["a▁b", " x", "x ", "\n", "a\tb", "é", "e\u0301", "\x85q", "q\u3000", "<s>", "日本", "😀", "\x00", "ﬁ", "x  y"]
    segments = [w for i, s in enumerate(odd) for w in (f"plain{i}", s, f"more{i}")]
    alone = [aligner.whole(s) for s in segments]
    assert aligner.whole("a▁b") is None and aligner.encode(segments) == alone
    assert aligner.encode(segments[::-1]) == alone[::-1]
    assert aligner.encode(["a▁b"]) == [None] and aligner.encode([]) == []
