"""Fill-in-the-middle, chat windows, tokenizer alignment."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import tokenizers
from fixture_tables import table  # noqa: F401
from pyspark.sql import functions as F

from ferrylake.llm import align, chat, fim, partids
from ferrylake.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"
A_PATH, B_PATH = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in the middle ------------------------------------------------------

def fim_by_hand(doc_id, text):
    t = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def fim_rows():
    rng = random.Random(5)
    odd = [None, "", "a", "\n", "x<P>y", "<M>", "$1 \\2 ${a}", "a<", "<<S", "P>", "🙂" * 50,
           "line\r\nline \x85", "é", "x" * 400_000, "🙂é" * 100_000]
    more = ["".join(rng.choice("ab🙂é \n<>$\\") for _ in range(rng.randrange(40)))
            for _ in range(120)]
    return list(enumerate(odd + more)) + [(None, "no id"), (3, "\n"), (3, "\n"), (-7, "below")]


def test_fim_equals_slicing_and_gives_the_text_back(spark, table):
    rows = fim_rows()
    out = fim.transform(table(rows, DOCS)).withColumn(
        "back", fim.restore(F.col("output"), F.col("form"))).collect()
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)
                              for r in out)
    assert got == collections.Counter((d, *fim_by_hand(d, t)) for d, t in rows)
    assert all(r.back == (r.text or "") for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fim_by_words_and_other_marks(spark, table):
    marks = fim.Marks("⟨$1⟩", "⟨suf.⟩", "⟨mid⟩")
    rows = [(i, t) for i, t in fim_rows() if len(t or "") < 1000]
    out = fim.transform(table(rows, DOCS), marks, unit=r"\S+\s*|\s+", fim_percent=100).withColumn(
        "back", fim.restore(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == (r.text or "") for r in out)
    assert all(r.form != "plain" for r in out if r.text)
    for r in out:
        if r.form == "psm":
            p, rest = r.output.removeprefix("⟨$1⟩").split("⟨suf.⟩")
            assert (r.prefix_chars, r.middle_chars) == (len(p), len(rest.split("⟨mid⟩")[1]))


def test_fim_marks_that_could_be_misread_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aa", "<S>", "<M>"),
                ("<a", "a>", "<M>"), ("xPx", "P", "<M>")):
        with pytest.raises(ValueError):
            fim.Marks(*bad)


def test_fim_empty_table(spark, table):
    assert fim.transform(table([], DOCS)).count() == 0


# --- chat --------------------------------------------------------------------

PIECES = ("hi", "<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|im_start|>", "a\nb", "é🙂 ", "\\n",
          "assistant", "|", "<")


def chat_rows():
    rng = random.Random(3)
    text = lambda n=12: "".join(rng.choice(PIECES) for _ in range(rng.randrange(n)))
    rows = []
    for c in range(25):
        for k in range(rng.randrange(1, 9)):
            role = "system" if k == 0 and rng.random() < .4 else rng.choice(
                ["user", "assistant", "a\nb", "back\\slash", "sys<|tem", "tool"])
            rows.append((c, k, role, text()))
    rows += [(77, k, ("user", "assistant")[k % 2] if k else "system", "word " * rng.randrange(30))
             for k in range(2500)]                                   # one hot conversation
    rows += [(78, 0, "system", "alone"), (None, 0, None, None), (None, 1, "assistant", "x" * 5000),
             (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"),
             (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"),
             (79, 0, "system", "long " * 300), (79, 1, "assistant", "w " * 500),
             (79, 2, "user", "b"), (79, 3, "assistant", "c"), (79, 4, "system", "again"),
             (80, 0, "user", "same"), (80, 0, "user", "same"), (80, None, "assistant", "no turn")]
    return rows


def ordered(rows):
    by = collections.defaultdict(list)
    for c, k, r, t in rows:
        by[c].append((k is not None, k or 0, r or "", t or ""))
    return {c: [x[2:] for x in sorted(xs, key=lambda x: x[:3])] for c, xs in by.items()}


def test_template_is_reversible():
    rng = random.Random(9)
    for _ in range(2000):
        turns = [("".join(rng.choice(PIECES) for _ in range(rng.randrange(4))),
                  "".join(rng.choice(PIECES) for _ in range(rng.randrange(8))))
                 for _ in range(rng.randrange(4))]
        text = "".join(chat.format_turn(*t) for t in turns)
        assert chat.read_turns(text) == turns
        assert text.count(chat.START) == text.count(chat.END) == len(turns)


@pytest.mark.parametrize("budget,history,blocks", [(2048, 512, 64), (100, 30, 2), (200, 0, 4)])
def test_windows_hold_every_turn_once(spark, table, budget, history, blocks):
    rows = chat_rows()
    w = chat.windows(table(rows, TURNS), A_PATH, budget, history, block_budgets=blocks).persist()
    want = ordered(rows)
    by = collections.defaultdict(list)
    for r in w.collect():
        by[r.conv_id].append(r)
    assert set(by) == set(want)
    for c, turns in want.items():
        head = turns[:1] if turns[0][0] == "system" else []
        at = 0
        for r in sorted(by[c], key=lambda r: r.first):
            said = chat.read_turns(r.formatted)
            assert r.first == at and r.n_turns == len(said)
            new = said[r.n_repeated:]
            assert new == turns[at:at + len(new)] and new
            repeated = said[:r.n_repeated]
            if at and head:                                  # the system turn stays
                assert repeated[0] == head[0]
                repeated = repeated[1:]
            assert repeated == turns[at - len(repeated):at]  # then the turns just before
            n = [chat.turn_tokens(A_PATH, *t) for t in said]
            assert sum(n) == r.n_tokens
            if sum(n) > budget:                              # one turn that fits in no window
                assert len(new) <= 1 + (at == 0 and bool(head)) and not repeated
            assert sum(chat.turn_tokens(A_PATH, *t) for t in repeated) <= history
            masked = [chat.unescape(r.formatted[s.start:s.stop]) for s in r.loss]
            assert masked == [t for role, t in new if role == "assistant"]
            at += len(new)
        assert at == len(turns)
    got = {r.conv_id: r for r in chat.digests(w).collect()}
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256,
                got[c].formatted_chars) == (
            len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss),
            sum(len(r.formatted) for r in by[c]))
    w.unpersist()


def test_spans_follow_prefix_sums():
    assert list(chat.spans(np.array([4, 4, 4, 4]), 0, 10, 0, 4)) == [(0, 0, 2), (1, 2, 3), (2, 3, 4)]
    assert list(chat.spans(np.array([4, 30, 4]), 0, 10, 2, 4)) == [(0, 0, 1), (1, 1, 2), (2, 2, 3)]
    assert list(chat.spans(np.array([3, 3, 4]), 2, 10, 0, 3)) == [(1, 2, 3)]


def test_chat_empty_table(spark, table):
    w = chat.windows(table([], TURNS), A_PATH)
    assert w.count() == 0 and chat.digests(w).count() == 0


# --- alignment ---------------------------------------------------------------

def align_rows():
    rng = random.Random(7)
    odd = [None, "", " ", "  two", "a  b", "a\n \nb x", "q\n\n y \n", "  x y  z", "a▁b",
           "plain ▁ here", "<|endoftext|></s><s> x", "中文字 한글 🙂🙂‍ tést " + "=" * 70,
           "\x00 \x01", "word " * 5000, "日本語テキスト🙂é́" * 40, "y" * 3000, " " * 500, "١٢٣ Ⅳ ½"]
    more = ["".join(rng.choice(("the ", "Wort, ", "éa", "🙂", "\n", "x.y", "  ", "中", "12 "))
                    for _ in range(rng.randrange(60))) for _ in range(60)]
    return list(enumerate(odd + more)) + [(None, "no id"), (500, more[0]), (500, more[0])]


def align_by_hand(rows):
    """The contract, document by document, with the libraries themselves."""
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letter = {c: i for i, c in enumerate(partids.byte_letters())}
    made, holds = [], collections.Counter()
    for _, text in rows:
        t = text or ""
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        ba = [bytes(letter[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
              else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            ia, ib, ba, bb = [], [], [], []
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (ba, bb)]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(cut) + 1 for e in ends]
            groups.append((ia[at[0]:to[0]], ib[at[1]:to[1]]))
            at = to
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        holds.update(set(links))
        made.append((len(ia), len(ib), groups, links))
    best = collections.Counter()
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    return collections.Counter(
        (d, na, nb, len(g), len(ls), sum(holds[p] == best[p[0]] for p in ls),
         sum(holds[p] for p in ls),
         sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g))
         if g else "")
        for (d, _), (na, nb, g, ls) in zip(rows, made))


@pytest.mark.parametrize("chars,lane,keys", [(3_000_000, 512, 3_000_000), (300, 16, 50)])
def test_alignment_equals_brute_force(spark, table, chars, lane, keys):
    rows = align_rows()
    out = align.report(table(rows, DOCS), A_PATH, B_PATH, block_chars=chars, lane_bytes=lane,
                       range_keys=keys).collect()
    assert collections.Counter(
        (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        for r in out) == align_by_hand(rows)


def test_aligned_gives_ids_and_groups(spark, table):
    rows = align_rows()
    want = align_by_hand(rows)
    for r in align.aligned(table(rows, DOCS), A_PATH, B_PATH).collect():
        at, parts = (0, 0), []
        for g in r.groups:
            parts.append(",".join(map(str, r.a_ids[at[0]:g.a_end])) + "|"
                         + ",".join(map(str, r.b_ids[at[1]:g.b_end])))
            at = g.a_end, g.b_end
        if r.groups:
            assert r.groups[-1].byte_end == len((" " + dict(rows)[r.doc_id]).encode())
        assert any(x[0] == r.doc_id and x[-1] == (sha(";".join(parts)) if parts else "")
                   for x in want)


def test_large_groups_are_multiplied_out_in_slices():
    pair = align._tokenizers(A_PATH, B_PATH)
    a, b = align.tokenise(["日本語テキスト🙂é́" * 30, "x y", "=" * 99], pair)
    links = align.merge(a, b, 8)
    g = align._groups(a, links)
    whole = align.document_pairs(a, b, links, g, 32_000)
    for most in (1, 2, 7):
        cut = align.document_pairs(a, b, links, g, 32_000, most)
        assert all((x == y).all() for x, y in zip(whole, cut))
    assert whole[2].sum() == ((g.a_end - g.a_start) * (g.b_end - g.b_start)).sum()


def test_lanes_do_not_change_the_merge():
    pair = align._tokenizers(A_PATH, B_PATH)
    a, b = align.tokenise([t or "" for _, t in align_rows()], pair)
    whole = align.merge(a, b, 1 << 40)
    for lane in (1, 5, 64):
        assert all((x == y).all() for x, y in zip(whole, align.merge(a, b, lane)))


def test_alignment_of_an_empty_table(spark, table):
    assert align.report(table([], DOCS), A_PATH, B_PATH).count() == 0


def test_part_store_keeps_parts_in_use():
    asked = []

    def encode(parts):
        asked.extend(parts)
        return (partids.laid([[ord(c) for c in p] for p in parts]),)

    store = partids.PartIds(encode, 1, 3)
    rng = random.Random(1)
    for _ in range(200):
        parts = ["hot"] + ["".join(rng.choice("ab") for _ in range(rng.randrange(5)))
                           for _ in range(4)]
        store.turn()
        rows = store.rows(parts)
        store.learn()
        n, flat = store.ids(rows)
        assert n.tolist() == [len(p) for p in parts]
        assert "".join(map(chr, flat)) == "".join(parts)
        assert len(store.young) <= 3 + len(parts)
    assert asked.count("hot") == 1
