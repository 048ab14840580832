"""Alignment of tokenizers against a plain version."""

import hashlib
import random
from collections import Counter

import pytest

from convolens.llm import alignment
from convolens.llm.queries import piece_path, tokenizer_path

from .test_operators import prose

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    out = [prose(rng, rng.randint(1, 80)) for _ in range(30)]
    out += ["\n".join(prose(rng, rng.randint(3, 12)) for _ in range(5)) for _ in range(10)]
    out += ["<|endoftext|> <s></s> <unk> <0x41>", "a ▁ b", "two  spaces", " ahead", "behind ", "\n", "a\n", "\nb", "x\r\ny\tz", "no break", "日本語 の テスト", "don't, it's 1 22 333!", "😀 a😀b é ́x", "\0", "　w"]
    return [*out, "", None, None, prose(rng, 20_000), *[out[0]] * 40, out[1]]


def plain(texts):
    """Whole texts, tokens as spans of bytes, groups and links by looking at each end."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = {}, 0
    for byte in range(256):
        letters[chr(byte) if byte in printable else chr(256 + extra)] = byte
        extra += byte not in printable

    def spans(tokens):
        out, at = [], 0
        for i, data in tokens:
            out.append((i, at + len(data)))
            at += len(data)
        return out, b"".join(d for _, d in tokens)

    aligned = []
    for text in texts:
        data = (" " + (text or "")).encode()
        one, bytes_one = spans([(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(data.decode(), add_special_tokens=False).ids])
        two, bytes_two = spans([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text or "")])
        if not text or bytes_one != data or bytes_two != data:
            aligned.append(None)
            continue
        ends, groups, links = {e for _, e in one} & {e for _, e in two}, [], []
        inside: tuple[list, list] = ([], [])
        for end, side, i in sorted([(e, 0, i) for i, e in one] + [(e, 1, i) for i, e in two]):
            inside[side].append(i)
            if end in ends and side == 1:
                groups.append("|".join(",".join(map(str, x)) for x in inside))
                links.append((inside[0][-1], i))
                inside = ([], [])
        aligned.append((len(one), len(two), groups, links))
    counts = Counter(p for x in aligned if x for p in x[3])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == most[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in aligned]


def test_alignment_equals_a_plain_version(spark, texts):
    rows = [(i, t, 1, "x", 7) for i, t in enumerate(texts)] + [(None, texts[3], 2, "y", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies int, digest string, n long").repartition(3)
    want = Counter(zip([r[0] for r in rows], plain([r[1] for r in rows])))
    have = alignment.align_tokenizers(docs, tokenizer_path(), piece_path())
    assert have.columns == ["doc_id", *NAMES]
    assert Counter((r[0], tuple(r[1:])) for r in have.collect()) == want
    assert sum(x[1][0] == 0 for x in want) >= 4


def test_nothing_to_align(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokenizers(docs, tokenizer_path(), piece_path()).collect() == []
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align_tokenizers(empty, tokenizer_path(), piece_path()).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_chunks_give_what_whole_texts_give(texts, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 50)
    by_chunks, whole = (alignment.Aligner(tokenizer_path(), piece_path()) for _ in range(2))
    assert by_chunks.cuts
    whole.cuts = False
    for text in texts:
        one, two = by_chunks.align(text or ""), whole.align(text or "")
        assert (one is None) == (two is None)
        assert one is None or (one[:3] == two[:3] and one[3].tolist() == two[3].tolist())


def test_linked_pairs_end_each_other(texts):
    aligner = alignment.Aligner(tokenizer_path(), piece_path())
    for text in texts:
        if found := aligner.align(text or ""):
            for link in found[3].tolist():
                one, two = aligner.bytes_a[link >> 32], aligner.bytes_b[link & 0xFFFFFFFF]
                assert one.endswith(two) or two.endswith(one)
