"""The corpus operators on small tables, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sparkquarry.llm import (  # noqa: E402
    bpe, chat_format, decontaminate, embedding_dedup, jaccard_join, language_id, line_dedup, lm_score, suffix_dedup, token_files,
)

rng = random.Random(5)
VOCAB = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(rng.choices(VOCAB, k=n))


BASE = prose(120)
PASSAGE = prose(30)


def near(text: str, edits: int) -> str:
    words = text.split(" ")
    for i in rng.sample(range(len(words)), edits):
        words[i] = "edit" + str(rng.randint(0, 10**6))
    return " ".join(words)


TEXTS = [
    BASE, BASE, BASE.upper(), *[near(BASE, k) for k in (1, 1, 2, 3, 9, 30)], None, "", "   \n\t ", "one", "One", "two words\n\n", "x" * 5000, "ab " * 3000,
    prose(40) + "\n" + PASSAGE + "\n" + prose(40), prose(30) + "\n  " + PASSAGE + " \n" + PASSAGE, "\n".join([PASSAGE] * 3), "<|endoftext|>ΑΣ 'S İ ½ \x00 🤗 </s>", prose(2000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens int, label int, token string, block long, key int"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that the operators use inside."""
    rows = [(i * 3, t, "xx", "src", 1, 2, "t", 4, 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df, *columns):
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    found = {r[0]: r[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return (text or "").encode().lower().split()


def components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_line_dedup(docs, none, tmp_path):
    found = line_dedup.dedup_lines(docs)
    assert set(found.columns) == {*docs.columns, "n_lines", "n_dropped"}
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(line_dedup.SQL).fetchall()}
    got = {k: (a, b, sha(t)) for k, (a, b, t) in by_id(found, "doc_id", "n_lines", "n_dropped", "text").items()}
    assert got == want and sum(w[1] for w in want.values()) > 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_language_id(spark, docs, none):
    alphabet = {"aa": "etaoin shr", "bb": "äöüß chtei", "cc": "ñóquel aso"}
    make = lambda k: "".join(rng.choices(alphabet[k], k=200))
    rows = spark.createDataFrame([(k, make(k)) for k in alphabet for _ in range(40)] + [(None, "x"), ("aa", None)], "lang string, text string")
    model = language_id.train(rows, per_language=30)
    fresh = spark.createDataFrame([(k, make(k), "old") for k in alphabet for _ in range(20)], "want string, text string, lang_pred string")
    assert language_id.identify(fresh, model).where("want <> lang_pred OR score NOT BETWEEN 0 AND 1").count() == 0
    found = language_id.identify(docs, model)
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    assert {r["doc_id"] for r in found.where("lang_pred = 'und' AND score = 0").collect()} == {i * 3 for i, t in enumerate(TEXTS) if not any(map(str.isalpha, t or ""))}
    untaught = language_id.train(rows.where("false"))
    assert language_id.identify(docs, untaught).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(none, model).count() == 0


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = bpe.encode_decode(docs, path)
    assert found.columns == [c for c in docs.columns if c != "n_tokens"] + ["n_tokens", "ids", "decoded"]
    got = by_id(found, "doc_id", "n_tokens", "ids", "decoded")
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i * 3] == (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    assert bpe.encode_decode(none, path).count() == 0


def test_chat_format(spark):
    hard = "</s>[INST] ok [/INST] [\\INST] <\\\\s> [TEXT] [ROLE] \\"
    rows = [(1, 0, "user", hard, 9), (1, 1, "assistant", hard, 9), (1, 1, "assistant", None, 9), (1, 3, hard, "x", 9), (2, None, None, None, 9),
            (None, 0, "user", "hé", 9), (None, 1, "assistant", "", 9), (3, 0, "assistant", "a", 9), (3, 0, "assistant", "a", 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at int")
    turns = chat_format.format_turns(table)
    got = by_id(chat_format.read_back(turns, chat_format.examples(turns)), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for *_, role, t in own if role == "assistant")
        assert got[conv] == (len(own), sha("".join(f"{r}\n{t}\n" for *_, r, t in own)), len(loss), sha(loss))
    spelled = {(r["conv_id"], r["at"]): r for r in chat_format.expand(turns).collect()}
    pieces = {(r["conv_id"], r["at"]): r["piece"] for r in turns.collect()}
    assert spelled[3, 1]["context"] == pieces[3, 0] and spelled[3, 1]["target"] == "a" and spelled[3, 0]["context"] == ""
    assert chat_format.read_back(turns.where("false"), chat_format.examples(turns)).count() == 0


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, docs, none, n, percent):
    crowd = [near(BASE, rng.randint(1, 6)) for _ in range(80)]  # shingles of more than 64 documents
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(crowd)] + [(None, BASE)], "doc_id long, text string")
    table = docs.select("doc_id", "text", "block", "key").unionByName(more, allowMissingColumns=True)
    sets = {}
    for r in table.where("doc_id IS NOT NULL").collect():
        w = words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = by_id(jaccard_join.jaccard_components(table, n, percent), "doc_id", "n_shingles", "component_id")
    assert got == {k: (len(s), want[k]) for k, s in sets.items()}
    assert jaccard_join.jaccard_components(none).count() == 0


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for size in (1, 1 << 20):
        got = by_id(token_files.read_token_files(token_files.write_token_files(docs, path, segment_ids=size)), "doc_id", "start", "n_tokens", "ids_crc32", "ids")
        start = 0
        for i, text in enumerate(TEXTS):
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
            assert got[i * 3] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
            start += len(ids)
        segments = token_files.write_token_files(docs, path, segment_ids=size)
        places = [(i * 3, at) for i in range(len(TEXTS)) for at in (0, 1, 7, got[i * 3][1] - 1, got[i * 3][1])] + [(None, 0), (1, 0)]
        found = token_files.tokens_at(segments, docs.sparkSession.createDataFrame(places, "doc_id long, at int"))
        want = {(d, at): got[d][3][at] for d, at in places if d in got and at < got[d][1]}
        assert {(r["doc_id"], r["at"]): r["token"] for r in found.collect()} == want
    assert token_files.read_token_files(token_files.write_token_files(none, path)).count() == 0
    numbers = np.array([0, 255, 256, 65535, 65536, 2**32 - 1] * 300, np.uint32)
    codes = token_files.Codes(token_files.pack(numbers))
    assert (codes.all() == numbers).all() and [codes[i] for i in range(len(codes))] == numbers.tolist()


def test_decontaminate(spark, docs, none):
    items = [(1, PASSAGE), (2, near(PASSAGE, 10)), (3, None), (4, ""), (5, "two words"), (6, near(BASE, 1)), (6, near(BASE, 1))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, text in enumerate(TEXTS):
        for item_id, item in items:
            a, b = words(text), words(item)
            if not a or not b:
                continue
            n = min(5, len(b))
            grams = lambda w: Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1))  # noqa: E731, B023
            target = grams(b)
            for at in range(max(1, len(a) - len(b) + 1)):
                window = grams(a[at : at + len(b)])
                if (window & target).total() >= 0.8 * (window | target).total():
                    want.add((i * 3, item_id))
                    break
    found = decontaminate.contaminated(docs, benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 3
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0


@pytest.mark.parametrize("recall", [1.0, 0.95])
def test_embedding_dedup(spark, recall):
    make = np.random.default_rng(3)
    centres = make.normal(size=(25, 16))
    vectors = [(centres[i % 25] + make.normal(size=16) * 0.18).tolist() for i in range(300)]
    vectors += [vectors[0]] * 3 + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, i % 2, "x") for i, v in enumerate(vectors)] + [(900, vectors[0], None, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell string")
    fine = {}
    for i, v, label, _ in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            fine[i] = (label, np.array(v) / np.linalg.norm(v))
    links = [(a, b) for a in fine for b in fine if a < b and fine[a][0] == fine[b][0] and len(fine[a][1]) == len(fine[b][1]) and fine[a][1] @ fine[b][1] >= 0.93]
    ends = Counter(x for pair in links for x in pair)
    group = components(links, [r[0] for r in rows])
    got = by_id(embedding_dedup.near_duplicates(table, target_recall=recall, per_cell=20), "vec_id", "n_links", "component_id", "kept")
    if recall == 1:
        assert got == {k: (ends[k], c, c == k) for k, c in group.items()}
    assert sum(g[0] for g in got.values()) >= 0.9 * 2 * len(links) > 200
    assert all(got[k][0] <= ends[k] for k in got)
    assert embedding_dedup.near_duplicates(table.where("false")).count() == 0
    assert embedding_dedup.near_duplicates(table.where("embedding IS NULL")).count() == 1


def test_lm_score(docs, none):
    from pyspark.sql import functions as F

    got = by_id(lm_score.suffix_tree_scores(docs, F.col("doc_id") % 5 != 0), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    tokens = {i * 3: [*words(t), None] for i, t in enumerate(TEXTS)}
    counts = Counter(w for d, t in tokens.items() if d % 5 for w in t)
    total = counts.total()
    for d, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in t)
        assert got[d][:3] == (len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(got[d][3], base, rel_tol=1e-9) and got[d][4] < 0
    assert got[0][4] > got[0][3]  # held out, but its copies are known
    assert lm_score.suffix_tree_scores(none, F.lit(True)).count() == 0
    untaught = by_id(lm_score.suffix_tree_scores(docs, F.lit(False)), "doc_id", "train_tokens", "base_score", "score")
    assert set(untaught.values()) == {(0, 0.0, 0.0)}


@pytest.mark.parametrize("crowd", [1, suffix_dedup.CROWD])
def test_suffix_dedup(docs, none, crowd):
    seen, want = {}, {}
    for i, text in enumerate(TEXTS):
        data = (text or "").encode()
        gone = [False] * len(data)
        for at in range(len(data) - 49):
            if seen.setdefault(data[at : at + 50], i) < i:
                gone[at : at + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i * 3] = (len(data), sum(gone), bytes(b for b, g in zip(data, gone) if not g), spans)
    found = suffix_dedup.dedup_substrings(docs, crowd)
    got = {k: (*v[:2], bytes(v[2]), len(v[3])) for k, v in by_id(found, "doc_id", "n_bytes", "n_removed", "kept", "starts").items()}
    assert got == want and sum(w[1] for w in want.values()) > 1000
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_suffix_dedup_tells_surroundings_apart(spark):
    """Two surroundings of one gram, whose hashes are equal in 32 bits, share no string."""
    s = suffix_dedup
    make = np.random.default_rng(1)
    letters = lambda *shape: make.integers(97, 123, shape).astype(np.uint16)
    grams = letters(50_000, s.GRAM)
    gram = grams[s.hashes(grams, s.GRAM)[:, 0].argmin()]  # is sampled wherever it stands
    around = letters(250_000, s.SPAN)
    around[:, s.REACH : s.LENGTH] = gram
    found = np.concatenate([s.hashes(part, s.SPAN)[:, 0] for part in np.split(around, 25)])
    order = np.argsort(found)
    same = np.flatnonzero(np.diff(found[order] >> np.uint64(32)) == 0)
    assert len(same)
    pairs = around[np.stack([order[same], order[same + 1]], 1).ravel()].astype(np.uint8)
    docs = spark.createDataFrame([(i, p.tobytes().decode()) for i, p in enumerate(pairs)], "doc_id long, text string")
    assert {r["n_removed"] for r in s.dedup_substrings(docs).collect()} == {0}


def test_language_id_letters_beyond_the_basic_plane(spark):
    gothic, adlam = "𐌰𐌹𐌽𐍃 𐍄𐍅𐌰", "𞤀𞤣𞤤𞤢𞤥"
    docs = spark.createDataFrame([(1, gothic), (2, adlam), (3, "🤗 12")], "doc_id long, text string")
    model = language_id.train(spark.createDataFrame([("got", gothic), ("ff", adlam)], "lang string, text string"))
    got = by_id(language_id.identify(docs, model), "doc_id", "lang_pred")
    assert got == {1: ("got",), 2: ("ff",), 3: ("und",)}


def test_stages_judge_rows(spark, tmp_path):
    """Null and repeated ids, against what each row's own text asks for."""
    import corpus_pipeline

    own = random.Random(8)
    text = lambda n: " ".join("".join(own.choices("abcdefgh", k=6)) for _ in range(n))
    item, copied, one, two, clean, lone = (text(n) for n in (20, 60, 40, 41, 42, 43))
    rows = [
        (1, one), (1, two), (2, copied), (2, copied), (3, two + " tail"), (None, copied), (None, clean), (None, lone), (None, lone),
        (4, text(9) + " " + item + " " + text(9)), (4, text(30)), (None, text(8) + " " + item), (5, None), (None, "12 34"),
    ]
    docs = spark.createDataFrame([(*r, "xx", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    once = [r for i, r in enumerate(rows) if i not in (3, 4, 5, 8)]
    assert texts(jaccard_join.jaccard_stage(spark, docs, str(tmp_path))) == Counter(once)
    apart = [r for r in rows if item not in (r[1] or "")]
    assert texts(decontaminate.decontaminate_stage(spark, docs, str(tmp_path))) == Counter(apart)
    found = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())
    assert found == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 1), (4, 4), (4, 4), (5, 5)]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(None, clean), (None, lone), (1, one), (1, two)} <= {(r["doc_id"], r["text"]) for r in out}
    assert not any(item in r["text"] for r in out)


def suffix_tree_by_hand(docs, weights=(1.0, 8.0, 64.0), least_count=2, cutoff=2.0, least_left=0.25, max_depth=None):
    """The score of every (tokens, train) by plain dictionaries."""
    rows = [(["<s>", *tokens, "</s>"], known) for tokens, known in docs]
    ones = Counter(w for r, known in rows if known for w in r[1:])
    total, types = ones.total(), len(ones)
    places = [(d, i) for d, (r, _) in enumerate(rows) for i in range(1, len(r))]
    root = lambda w, own: max(ones[w] - own + 0.1, 0.1) / max(total - own + 0.1 * (types + 1), 0.1)
    whole = {(d, i): root(rows[d][0][i], 0) for d, i in places}
    apart = {(d, i): root(rows[d][0][i], int(rows[d][1])) for d, i in places}
    open_ = set(places)
    for k in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32):
        if max_depth is not None and k > max_depth:
            break
        context = {(d, i): tuple(rows[d][0][i - k : i]) for d, i in open_ if i >= k}
        n, g = Counter(), Counter()
        for r, known in rows:
            for i in range(k, len(r)) if known else ():
                n[tuple(r[i - k : i])] += 1
                g[tuple(r[i - k : i + 1])] += 1
        open_ = {x for x in context if n[context[x]] >= least_count}
        gain, left = {w: Counter() for w in weights}, Counter()
        seen = {(d, i): g[(*context[d, i], rows[d][0][i])] for d, i in open_}
        mixed = lambda x, w, own, p: (seen[x] - own + w * p[x]) / (n[context[x]] - own + w)  # noqa: B023, E731
        for x in open_:
            own, s = int(rows[x[0]][1]), context[x]
            for w in weights:
                gain[w][s] += own * np.rint(256 * math.log(mixed(x, w, own, apart) / apart[x]))
            least = max(cutoff / n[s], least_left)
            left[s] += own * np.rint(256 * ((seen[x] > 1) * -math.log(mixed(x, weights[0], own, apart)) - least))
        for x in open_:
            best = max(weights, key=lambda w: (gain[w][context[x]], -w))  # noqa: B023
            if gain[best][context[x]] >= 256 * cutoff:
                whole[x], apart[x] = mixed(x, best, 0, whole), mixed(x, best, int(rows[x[0]][1]), apart)
        open_ = {x for x in open_ if left[context[x]] >= 0}
    scores = [0.0] * len(rows)
    for (d, _), chance in whole.items():
        scores[d] += math.log10(chance)
    return scores


@pytest.mark.parametrize("depth", [None, 2, 0])
def test_lm_score_equals_a_tree_by_hand(spark, depth):
    from pyspark.sql import functions as F

    own = random.Random(11)
    some = ["".join(own.choices("abc", k=2)) for _ in range(12)]
    line = lambda k: own.choices(some, k=k)
    common = line(14)
    texts = [line(own.randint(0, 25)) for _ in range(60)]
    texts += [line(3) + common[: own.randint(4, 14)] + line(4) for _ in range(25)] + [common] * 2
    rows = [(t, i % 7 != 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, " ".join(t), known) for i, (t, known) in enumerate(rows)], "doc_id long, text string, known boolean").repartition(3)
    got = by_id(lm_score.suffix_tree_scores(docs, F.col("known"), max_depth=depth), "doc_id", "score", "base_score")
    want = suffix_tree_by_hand(rows, max_depth=depth)
    assert [got[i][0] for i in range(len(rows))] == pytest.approx(want, rel=1e-4)
    if depth == 0:
        assert all(math.isclose(*v) for v in got.values())


def test_lm_score_is_the_same_however_rows_are_dealt(spark):
    from pyspark.sql import functions as F

    own = random.Random(12)
    some = ["".join(own.choices("abcd", k=2)) for _ in range(14)]
    passages = [own.choices(some, k=20) for _ in range(6)]
    texts = [" ".join(own.choices(some, k=own.randint(0, 40)) + own.choice(passages)[own.randint(0, 10) :] + own.choices(some, k=5)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, i % 6 != 0) for i, t in enumerate(texts)], "doc_id long, text string, known boolean")
    one, seven = (by_id(lm_score.suffix_tree_scores(docs.repartition(k, "doc_id"), F.col("known")), "doc_id", "score") for k in (1, 7))
    assert all(math.isclose(one[i][0], seven[i][0], rel_tol=1e-9) for i in range(400))


def test_lm_score_long_contexts(spark):
    """What follows a passage depends on the word before it, six words back."""
    from pyspark.sql import functions as F

    rows = [(f"{first} p q r s t {last}", True) for first, last in (("a", "x"), ("b", "y")) for _ in range(30)]
    rows += [("a p q r s t x", False), ("a p q r s t y", False)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, known boolean")
    got = by_id(lm_score.suffix_tree_scores(docs, F.col("known")), "doc_id", "score")
    assert got[60][0] > got[61][0] + 0.5


def test_lm_score_sends_a_row_for_each_part_and_range(spark, monkeypatch):
    """Not one for each block and kind: 40 partitions make 40 blocks, but so little text makes one part."""
    from pyspark.sql import functions as F

    rows, cut = [], lm_score.cut

    def counted(df, name):
        back = cut(df, name)
        rows.append(back.count())
        return back

    monkeypatch.setattr(lm_score, "cut", counted)
    own = random.Random(13)
    some = ["".join(own.choices("abcdefgh", k=3)) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(own.choices(some, k=40)), i % 6 != 0) for i in range(400)], "doc_id long, text string, known boolean")
    assert lm_score.suffix_tree_scores(docs.repartition(40, "doc_id"), F.col("known"), max_depth=2).count() == 400
    assert max(rows) <= 16 + 2  # 16 ranges; a part's state and scores


def test_columns_of_any_name_pass_through_line_dedup(spark):
    """The operator's own names, clashing; repeated and missing ids; three documents to make a line common."""
    line, other = "a line that is long enough", "another line of some length"
    rows = [(1, line, 7, 8, 9, 10, 11), (1, line + "\n" + other, 7, 8, 9, 10, 11), (2, other + "\n" + line, 7, 8, 9, 10, 11), (3, line, 7, 8, 9, 10, 11), (None, line, 7, 8, 9, 10, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _th int, _doc int, _text int, _dropped int, _row int")
    found = sorted(tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "text", "n_dropped", "_th", "_doc", "_text", "_dropped", "_row").collect() if r[0])
    assert found == [(1, line, 0, 7, 8, 9, 10, 11), (1, line + "\n" + other, 0, 7, 8, 9, 10, 11), (2, "", 2, 7, 8, 9, 10, 11), (3, "", 1, 7, 8, 9, 10, 11)]
    three = {(r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    assert three == {(1, 0), (2, 1), (3, 1), (None, 0)}


def test_line_dedup_takes_time_in_proportion_to_lines(spark):
    import time

    docs = spark.createDataFrame([(1, "\n".join(f"line number {i}" for i in range(60_000))), (2, "\n".join(f"line number {i}" for i in range(0, 60_000, 2)))], "doc_id long, text string")
    began = time.time()
    assert sorted(r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()) == [0, 30_000]
    assert time.time() - began < 60


def test_bpe_knows_the_library_s_letters(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    own = random.Random(2)
    texts = ["\ua7cb x", "\u1c89\u1c8a", "\U00010d50 a", "\U00011935\U00011930", "e\u0301\u0344"]
    texts += ["".join(chr(c) + " " * (own.random() < 0.2) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000) for low in range(0x80, 0x1F000, 64)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(bpe.encode_decode(docs, path), "doc_id", "ids")
    assert [got[i][0] for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_fingerprints_within_the_radius_are_found():
    own = np.random.default_rng(0)
    items = own.integers(0, 256, (300, 16), dtype=np.uint8)
    queries = []
    for bits in (0, 5, 20, decontaminate.RADIUS):
        for item in items[:50]:
            flipped = np.unpackbits(item)
            flipped[own.choice(128, bits, replace=False)] ^= 1
            queries.append(np.packbits(flipped))
    index = decontaminate.BlockIndex(items)
    rows, found = index.within(np.stack(queries))
    assert {(i, i % 50) for i in range(200)} <= set(zip(rows.tolist(), found.tolist()))
    rows, _ = index.near(own.integers(0, 256, (1000, 16), dtype=np.uint8))
    assert len(rows) < 0.12 * 1000 * 300


def test_language_sample_takes_different_texts(spark):
    rows = [("aa", "etaoin shrdlu")] * 500 + [("aa", f"etaoin {i}") for i in range(30)] + [("bb", "äöü ß")]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"), per_language=5)
    assert {m for f in model.families for m in f} == {"aa", "bb"}


def test_components_of_chains_and_stars(spark):
    from sparkquarry.llm.components import components as of

    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in of(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert of(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_files_keep_their_numbers(spark, docs, tmp_path):
    from sparkquarry.llm.shared import numbered

    docs.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    rows = numbered(read, "_n")
    one, two = (sorted((r["doc_id"], r["_n"]) for r in rows.repartition(k).collect()) for k in (1, 3))
    assert one == two and len({n for _, n in one}) == len(TEXTS) and rows.columns == [*docs.columns, "_n"]
    assert len({r["_n"] for r in numbered(docs, "_n").collect()}) == len(TEXTS)
    assert numbered(read.where("false"), "_n").count() == 0
