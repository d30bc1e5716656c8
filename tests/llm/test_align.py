import hashlib
import random
from collections import Counter, defaultdict

import pytest

from gleaner.llm import align, pieces
from gleaner.llm.token_file import tokenizer_path

A, B = tokenizer_path(), pieces.model_path()


class Plain:
    """Whole texts through the libraries, token by token."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        rest = [b for b in range(256) if b not in keep]
        self.byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}

    def tokens(self, text):
        if not text:
            return [], []
        enc = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in enc.ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def spans(self, tokens):
        at, out = 0, []
        for i, x in tokens:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def one(self, text):
        """n_a, n_b, groups, links"""
        a, b = (self.spans(t) for t in self.tokens(text))
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, last = [], 0
        for e in both:
            groups.append(([i for i, s, z in a if last < z <= e], [i for i, s, z in b if last < z <= e]))
            last = e
        links, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        return len(a), len(b), groups, links

    def table(self, texts):
        each = [self.one(t) for t in texts]
        docs = Counter(p for *_, links in each for p in set(links))
        most = defaultdict(int)
        for (a, _), n in docs.items():
            most[a] = max(most[a], n)
        out = []
        for n_a, n_b, groups, links in each:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            best = sum(docs[p] == most[p[0]] for p in links)
            out.append((n_a, n_b, len(groups), len(links), best, sum(docs[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        return out


def odd_texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "Straße", "naïve", "don't", "x=1;", "12345", "日本語", "🙂👍", "▁", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "a\tb", "\x00", "　", "\x85", "…", "  ", "\n", "\n\n", "\r\n", " \n ", "é", "é", "<unk>", "​", "ok", "word", "it's", "'s"]
    out = [None, "", " ", "\n", "  ", "a", " a", "a ", "a  ", "\na", "a\n", "a \nb", "a\n b", "▁", "x" * 300, "the " * 50, "<|endoftext|>", "a<s>b", "\t", "a\t b"]
    while len(out) < n:
        out.append("".join(rng.choice(words) + rng.choice(["", " ", " ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(25))))
    return out


@pytest.mark.parametrize("part", [1_000_000, 7])
def test_every_column_against_the_libraries(spark, monkeypatch, part):
    monkeypatch.setattr(align, "PART", part)
    texts = odd_texts(150, part)
    own = align.Aligner(A, B)
    got = own.align(texts, True)
    plain = Plain()
    for i, t in enumerate(texts):
        n_a, n_b, groups, links = plain.one(t)
        assert (i, t, *got.counts[i]) == (i, t, n_a, n_b, len(groups), len(links))
        lo, hi = got.pairs[0][i : i + 2]
        found = {(int(p) // own.n_b, int(p) % own.n_b): int(n) for p, n in zip(got.pairs[1][lo:hi], got.pairs[2][lo:hi], strict=True)}
        assert found == dict(Counter(links))
    assert got.hashes == [r[-1] for r in plain.table(texts)]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "extra", 3) for i, t in enumerate(texts)], "doc_id long, text string, row string, n_a int").repartition(3)


@pytest.mark.parametrize("frequent,held", [(1 << 19, 4_000_000), (40, 50), (0, 1)])
def test_report_against_all_documents(spark, monkeypatch, frequent, held):
    monkeypatch.setattr(align, "FREQUENT", frequent)
    monkeypatch.setattr(align, "HELD", held)
    texts = [*odd_texts(70, 5), *["the same text again"] * 9]
    want = Plain().table(texts)
    got = {r.doc_id: r for r in align.report(rows(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (texts[i], r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (texts[i], *w)


def test_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c"), (2, None)], "doc_id long, text string")
    got = align.report(df).collect()
    assert len(got) == 5 and {r.count_sum for r in got if r.n_a == 2} == {6}
    assert align.report(df.limit(0)).count() == 0
    assert [tuple(r) for r in align.report(df.filter("doc_id = 2")).collect()] == [(2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_themselves(spark, monkeypatch):
    monkeypatch.setattr(align, "PART", 9)
    texts = odd_texts(60, 3)
    out = {r.doc_id: r.groups for r in align.with_groups(rows(spark, texts)).collect()}
    plain = Plain()
    for i, t in enumerate(texts):
        assert [(g.a, g.b) for g in out[i]] == plain.one(t)[2]
        if out[i]:
            assert out[i][-1].end == len((" " + t).encode())


def test_a_small_cache_changes_nothing(monkeypatch):
    texts = odd_texts(60, 8)
    want = align.Aligner(A, B).align(texts)
    monkeypatch.setattr(align, "CACHE", 3)
    monkeypatch.setattr(align, "PART", 20)
    own = align.Aligner(A, B)
    again = [own.align([t]) for t in texts]
    assert [r.hashes[0] for r in again] == want.hashes and [r.counts[0].tolist() for r in again] == want.counts.tolist()


def test_a_long_text_is_aligned_whole():
    text = "Grüße an alle. " * 150_000
    got = align.Aligner(A, B).align([text, "x"])
    one = align.Aligner(A, B).align(["Grüße an alle. "])
    assert got.counts[0][0] > 140_000 * (one.counts[0][0] - 1) and got.counts[1][0] >= 1
