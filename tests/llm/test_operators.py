"""The training-data operators against brute force, round trips and held-out accuracy, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sextant.llm import bpe, ctw, language, matroska, packing, quality, simhash, substring, toxicity, wrapper
from sextant.llm.queries import queries, vocabulary

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, a string, Text2 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    made: dict = {}

    def get(name):
        if name not in made:
            made[name] = queries()[name](spark, DATA).collect()
        return made[name]

    return get


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    data = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, " \n\t ", "en", None), (5, long, "en", "s"), (6, long, "en", "s"), (7, "1234 !?", "en", "s"), (None, "x y z", "fr", "t")]
    return spark.createDataFrame([(*d, 0, "i", "a", "t") for d in data], SCHEMA)


def test_op1_against_brute_force(rows, docs):
    words = {i: WORD.findall(r["text"] or "") for i, r in docs.items()}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    removed = 0
    for r in rows("op1_substring_dedup"):
        w = words[r["doc_id"]]
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < r["doc_id"]:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        removed += sum(gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert removed


def test_op1_shifted_passages_and_batches(spark):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 130)]
    data = []
    for i in range(60):
        w = [x for p in rng.sample(passages, 3) for x in [*(word() for _ in range(rng.randrange(40))), *p]]
        data.append((i, " ".join(w)))
    found = substring.mark(spark.createDataFrame(data, "doc_id long, text string").repartition(7)).collect()
    split = {i: t.split() for i, t in data}
    first: dict = {}
    for i, w in split.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for r in found:
        w, gone = split[r["doc_id"]], set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < r["doc_id"]:
                gone.update(range(k, k + 50))
        assert r["kept_text"] == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


@pytest.mark.parametrize("kind, name", [(bpe.ByteBpe, "byte_bpe_50k.json"), (bpe.WordBpe, "word_bpe_49k.json")])
def test_op2_encodes_like_the_library(kind, name, docs):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ["", " ", "a  b", "a\n\nb", " a", "a\n b", "x <|endoftext|> y<|endoftext|>", "\x1c a", "日本語 🙂🙂 ok", "it's we'll DON'T 4a5", "ΣΑΣ. İs ſ ẞ", "a" * 300]
    texts += ["".join(rng.choice(" \n\ta1.É'ß́s🙂<|>Σ ") for _ in range(rng.randint(0, 25))) for _ in range(500)]
    texts += [r["text"] or "" for r in docs.values()]
    own, lib = kind(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    for text, found in zip(texts, own.encode(texts), strict=True):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(found, "<u4").tolist() == ids, text[:60]
        if kind is bpe.ByteBpe:
            assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_op2_heap_and_batch_agree():
    merges = bpe.ByteBpe(vocabulary("byte_bpe_50k.json")).merges
    rng = random.Random(2)
    pieces = ["".join(rng.choice("theand ingou") for _ in range(rng.randint(1, 38))).encode() for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.batch(pieces)] == [merges.heap(p) for p in pieces]


def test_op3_against_brute_force(rows, docs):
    fp = {}
    for i, r in docs.items():
        w = (r["text"] or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fp[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            low = min(root[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3)
            changed |= low != root[i]
            root[i] = low
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows("op3_simhash")} == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_op3_links_of_dense_fingerprints(spark):
    rng = random.Random(5)
    fps = {0}
    for c in [rng.getrandbits(64) for _ in range(30)]:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(sign(x),) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in simhash.connect(simhash.links(frame, 3)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    groups, own = Counter(), Counter()
    for x in fps:
        groups[find(x)] += 1
        own[found.get(sign(x), sign(x))] += 1
    assert sorted(groups.values()) == sorted(own.values())


def test_op4_finds_held_out_toxic_documents(spark):
    """By language, on rows that nothing was learned from. A twentieth of the toxic labels of this table mark texts without a toxic word."""
    root = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang").collect()}
    found = queries()["op4_toxicity"](spark, root).collect()
    assert len(found) == len(lang)
    held: dict = {}
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in labels:
            held.setdefault((lang[r["doc_id"]], labels[r["doc_id"]]), []).append(r["predicted"])
    for code in ("en", "fr", "de", "es"):
        assert sum(held[code, 1]) >= 0.8 * len(held[code, 1]), code
        assert sum(held[code, 0]) <= 0.05 * len(held[code, 0]), code
    toxic = [x for (_, y), v in held.items() if y for x in v]
    assert len(toxic) > 90 and sum(toxic) >= 0.9 * len(toxic)


def test_op4_grammar():
    weight = {"insult": 4.0, "threat": 1.0}
    words = toxicity.Lexicon({"idiot$": ("insult", weight["insult"]), "kill$": ("threat", weight["threat"]), "glorb": ("learned", 3.0), "glorbina$": ("learned", 0.0)}, -2.0)
    negated, reported, directed = toxicity.ADDED.values()
    assert words.clause("you are an idiot") == {"idiot": 4.0 + directed} == words.clause("idiot that you are")
    assert words.clause("she is not an idiot") == {"idiot": 4.0 + negated + directed}
    assert words.clause("nobody is no more nor less of the idiot") == {"idiot": 4.0}
    assert words.clause('the paper said "idiot" once') == {"idiot": 4.0 + reported}
    assert words.clause("i will kill you") == {"kill": 1.0 + directed} and words.clause("glorben glorbina") == {"glorben": 3.0}
    assert words.odds("") == -2.0 and words.odds("Kill the process. You wait.") == -1.0
    assert words.odds("An idiot! You idiot, idiot.") == -2.0 + 4.0 + directed  # once, where it weighs most
    assert words.odds("The idiot. Glorb.") == -2.0 + 4.0 + 3.0 and 0 < words.score("a" * 10**6) < 0.5


def test_op4_learns_words_and_stems(spark):
    rng = random.Random(5)
    filler = lambda: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(60)}" for _ in range(40))
    data, marks = [], []
    for i in range(400):
        y = i % 4 == 0
        word = ("zwaddle" if i % 8 else f"murxi{rng.choice('abcdefghij')}{rng.choice('klmnop')}") if y else rng.choice(["zwadd", "murmel", "bread"])
        data.append((i, f"{filler()}. The {word} {filler()}"))
        marks.append((i, int(y)))
    data += [(1000 + k, data[3][1]) for k in range(30)]  # copies of a clean text teach once
    frame = spark.createDataFrame(data, "doc_id long, text string")
    lexicon = toxicity.learn(frame, spark.createDataFrame(marks + [(1000 + k, 1) for k in range(30)], "doc_id long, toxic int"))
    learned = {a: w for a, (k, w) in lexicon.arcs.items() if k == "learned" and w > 0}
    assert {"zwaddle$", "murxi"} <= set(learned) and all(a == "zwaddle$" or a.startswith("murxi") for a in learned)
    assert lexicon.read("murxizz")[0] == "learned" and lexicon.read("murmel")[0] == "w" == lexicon.read("zwadd")[0]
    train = toxicity.learn(frame, spark.createDataFrame(marks, "doc_id long, toxic int"), toxicity.F.col("id") < 0)
    assert not [a for a, (k, _) in train.arcs.items() if k == "learned"]


def test_op4_keep_has_all_columns_and_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    frame = odd.selectExpr("*", "1 as toxic_id", "'x' as score").unionByName(odd.limit(1).selectExpr("doc_id", "'You are a worthless idiot' text", "lang", "source", "n_chars", "id", "a", "Text2", "1 toxic_id", "'x' score"))
    kept = toxicity.keep(frame, labels)
    assert kept.columns == frame.columns and sorted(map(str, kept.collect())) == sorted(map(str, frame.where("text is null or text not like '%idiot%'").collect()))


def test_op5_base_and_model(rows, docs):
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in docs}
    counts: Counter = Counter()
    for i, r in docs.items():
        if fold[i] != 2:
            counts.update([*(r["text"] or "").encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    for r in rows("op5_ctw"):
        tokens = [*(docs[r["doc_id"]]["text"] or "").encode().lower().split(), "end"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(t in counts for t in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert r["held_out"] == (fold[r["doc_id"]] == 2) and r["score"] < 0
    held = [r for r in rows("op5_ctw") if r["held_out"]]
    assert sum(-r["score"] for r in held) * 3.3219 / sum(r["n_bytes"] + 1 for r in held) < 3


def test_op5_against_brute_force(spark):
    """Weighted probabilities by the definition, node by node, on a few texts; rare and unseen contexts are looked up by a join."""
    from functools import cache

    rng = random.Random(11)
    texts = ["".join(rng.choice("ab cÄ") for _ in range(rng.randrange(60))) for _ in range(14)] + [None, "", "x" * 40, "zzzé"]
    train = [k % 3 != 0 for k in range(len(texts))]
    depth, counts = ctw.DEPTH, {}

    def steps(text):
        data = bytes([ctw.START]) * depth + (text or "").encode().lower() + bytes([ctw.END])
        for i in range(depth, len(data)):
            for k in range(8):
                yield data[i - depth : i], (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1

    for text, on in zip(texts, train, strict=True):
        for context, node, bit in steps(text) if on else ():
            for d in range(depth + 1):
                counts.setdefault((context[depth - d :], node), [0, 0])[bit] += 1

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)

    children: dict = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))

    @cache
    def weighted(key):
        own = kt(*counts[key])
        return own if len(key[0]) == depth else float(np.logaddexp(own, sum(map(weighted, children[key])))) - math.log(2)

    def one(context, node, d=0):
        """What the tree predicts from depth d on."""
        key = (context[depth - d :], node)
        if key not in counts:
            return 0.5
        zeros, ones = counts[key]
        estimate = (ones + 0.5) / (zeros + ones + 1)
        if d == depth:
            return estimate
        weight = math.exp(kt(zeros, ones) - math.log(2) - weighted(key))
        return weight * estimate + (1 - weight) * one(context, node, d + 1)

    frame = spark.createDataFrame([(k, t, on) for k, (t, on) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, key boolean")
    before = ctw.COMMON
    for common in (before, 40):
        ctw.COMMON = common
        try:
            found = {r["doc_id"]: r for r in ctw.score(frame.repartition(3), frame["key"]).collect()}
        finally:
            ctw.COMMON = before
        for k, text in enumerate(texts):
            want = sum(math.log10(p if bit else 1 - p) for context, node, bit in steps(text) for p in [one(context, node)])
            assert math.isclose(found[k]["score"], want, rel_tol=1e-9), (common, k)


def test_op5_kt_is_sequential():
    p, zeros, ones = 1.0, 0, 0
    for bit in (0, 1, 1, 0, 1):
        p *= ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
        zeros, ones = zeros + (bit == 0), ones + bit
    assert math.isclose(float(ctw.log_kt(np.array([2]), np.array([3]))[0]), math.log(p), rel_tol=1e-9)


def test_op6_round_trip_and_lacing(rows, docs):
    for r in rows("op6_matroska"):
        b = (docs[r["doc_id"]]["text"] or "").encode()
        p = matroska.padded(b)
        assert len(p) % 192 == 0 and (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    payload = matroska.padded(random.Random(1).randbytes(400_000))
    data = matroska.write(payload)
    media = matroska.parse(data)
    assert matroska.payload_of(data, media) == payload and [c[2] for c in media.cues] == [c - 12 + (12 - (c - data.rfind(b"\x1fC\xb6u", 0, c))) for c in media.clusters]
    for how in (matroska.XIPH, matroska.EBML_LACING):
        frames = [b"a" * 700, b"b" * 255, b"c" * 3, b"d" * 40]
        block = matroska.element(matroska.SIMPLE, matroska.number(1) + b"\0\0" + bytes([0x80 | how << 1]) + matroska._lace(frames, how))
        raw = matroska.element(matroska.SEGMENT, (0x1F43B675).to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.whole(matroska.TIMECODE, 0) + block)
        assert [raw[p[2] : p[2] + p[3]] for p in matroska.parse(raw).packets] == frames
    with pytest.raises(ValueError):
        matroska.parse(data[:-7])


def test_op7_main_text():
    page = "<html><body class='has-sidebar'><header>Site</header><nav><a href=/>Home</a></nav><div class=ad>Buy</div><article><h1>T &amp; U</h1><p><b>One<br>two<p>Three&nbsp; <script>x</script>four</article><section id=comments><p>Nice</p></section><footer>F</footer>"
    assert wrapper.main_text(page) == "T & U\nOne two\nThree four"
    assert wrapper.main_text("") == "" and wrapper.main_text("<nav>a</nav>") == "" and wrapper.main_text("just text") == "just text"


def test_op7_template_goes(spark):
    page = lambda k: f"<body><div class=top>Daily News since 1900</div><div class=story><p>Read all about it here</p>{''.join(f'<p>Story {k} paragraph {j} with words {k * 7 + j}.</p>' for j in range(3 + k))}</div></body>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(6)] + [(9, None, None)]
    found = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9] == "" and all(found[k].split("\n") == [f"Story {k} paragraph {j} with words {k * 7 + j}." for j in range(3 + k)] for k in range(6))


def test_op7_matching_against_brute_force():
    from functools import cache

    rng = random.Random(7)

    def tree(n):
        return wrapper.Pattern([""] + [rng.choice("abc") for _ in range(n)], [-1] + [rng.randrange(k) for k in range(1, n + 1)])

    for _ in range(60):
        a, b = tree(rng.randrange(9)), tree(rng.randrange(9))

        @cache
        def forest(xs, ys):
            if not xs or not ys:
                return 0
            both = 1 + forest(tuple(a.children[xs[0]]), tuple(b.children[ys[0]])) + forest(xs[1:], ys[1:]) if a.labels[xs[0]] == b.labels[ys[0]] else 0
            return max(both, forest(xs[1:], ys), forest(xs, ys[1:]))

        n, pairs = wrapper.match(a, b)
        assert n == len(pairs) == forest((0,), (0,)) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == n
        assert all(a.labels[i] == b.labels[j] and (i == 0 or (a.parents[i], b.parents[j]) in pairs) for i, j in pairs)


def test_op7_induction_needs_no_words_of_markup(spark):
    """Pages of sf0.01 whose articles, menus, adverts and footers are plain divs, each paragraph in one of its own."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    plain = lambda h: re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", h.replace("</h1>", "</h1><div>").replace("</article>", "</div></article>").replace("<p>", "</div><div><p>")).replace(' class="ad"', "")
    host = lambda r: r["url"].split("/")[2]
    pages = Counter(map(host, rows))
    frame = spark.createDataFrame([(r["page_id"], r["url"], plain(r["html"])) for r in rows if pages[host(r)] >= 3], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in wrapper.extract(frame).collect()}
    right: dict = {}
    for r in rows:
        if r["page_id"] in found:
            want = wrapper.main_text(r["html"])
            right.setdefault(host(r), []).append((found[r["page_id"]] == want, wrapper.main_text(plain(r["html"])) == want))
    assert len(right) > 30
    assert sum(all(x for x, _ in v) for v in right.values()) >= 0.9 * len(right)  # by induction
    assert sum(all(y for _, y in v) for v in right.values()) <= 0.1 * len(right)  # without


def test_op7_deep_wide_and_odd_pages(spark):
    import time

    deep, wide = "<div>" * 20_000 + "text", "".join(f"<p>{k}</p><h2>{k}</h2>" for k in range(20_000))
    for page, n in ((deep, 1), (wide, 40_000)):
        began = time.perf_counter()
        assert len(wrapper.main_text(page).split("\n")) == n
        assert time.perf_counter() - began < 2
    assert wrapper.induce([deep, deep + " more", "<p>a", None or "<p>b"]) == []
    data = [(1, "http://a.b/1", "<p>x"), (1, "http://a.b/1", "<p>x"), (2, None, "<article>y</article>"), (3, "nonsense", None), (None, "http://a.b/2", ""), (4, "http://a.b/3", deep), (5, "http://a.b/4", "<p>&#xD800;&amp")]
    frame = spark.createDataFrame([(*d, "m", 7, "t") for d in data], "page_id long, url string, html string, made string, host int, Text string")
    found = {(r["page_id"], r["url"]): r["text"] for r in wrapper.extract(frame).collect()}
    assert found == {(1, "http://a.b/1"): "x", (2, None): "y", (3, "nonsense"): "", (None, "http://a.b/2"): "", (4, "http://a.b/3"): "text", (5, "http://a.b/4"): "\ufffd&"}
    assert wrapper.extract(frame).count() == 7 and wrapper.extract(frame.limit(0)).collect() == []


def test_op8_held_out_accuracy(rows, docs):
    held = [r for r in rows("op8_language") if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != language.UNKNOWN]
    assert held and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_op8_many_languages(spark):
    """Each of 300 languages has a word of its own; more than LANGUAGES are learned by frequency."""
    code = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    rows = [(k, " ".join([code(k) + "x" + code(k)[::-1]] * 12), f"l{k}") for k in range(300) for _ in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(frame, frame["doc_id"] >= 0).collect()}
    assert language.bits_for(300) == 15 and sum(found[k] == f"l{k}" for k in range(300)) >= 295
    before, language.LANGUAGES = language.LANGUAGES, 10
    try:
        assert {r["lang_pred"] for r in language.predict(frame, frame["doc_id"] >= 0).collect()} <= {f"l{k}" for k in range(300)}
    finally:
        language.LANGUAGES = before


def test_op9_against_brute_force(rows, docs):
    for r in rows("op9_quality"):
        t = docs[r["doc_id"]]["text"] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert tuple(r[c] for c in quality.BASE) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_op9_verdicts_against_exact_quartiles(spark):
    """kept on sf0.01, but for ratios so near a limit that the sketch's two per cent decide; and each limit rejects in some group."""
    root = "/root/testdata/sf0.01"
    table = {r["doc_id"]: r for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in queries()["op9_quality"](spark, root).collect()}

    def values(i):
        r, lines = found[i], [x for x in (table[i]["text"] or "").split("\n") if WORD.search(x)]
        n = max(r["n_words"], 1)
        return {"symbols": r["n_symbols"] / n, "lines": r["n_dup_lines"] / max(len(lines), 1), "repeats": r["n_repeat_words"] / n, "length": r["word_chars"] / n}

    ratio = {i: values(i) for i in found}
    group = {i: (table[i]["lang"], table[i]["source"]) for i in found}
    levels = [(group, Counter(g for i, g in group.items() if found[i]["n_words"]))]
    levels.append(({i: g[0] for i, g in group.items()}, Counter(g[0] for i, g in group.items() if found[i]["n_words"])))
    levels.append((dict.fromkeys(found, ""), Counter()))
    seen, checked = Counter(), 0
    quart: dict = {}
    for i, r in found.items():
        level = next(k for k, (of, n) in enumerate(levels) if k == 2 or n[of[i]] >= quality.MIN_ROWS)
        of = levels[level][0]
        inside = sure = True
        for k, x in ratio[i].items():
            key = (level, of[i], k)
            if key not in quart:
                quart[key] = np.quantile([ratio[j][k] for j in found if of[j] == of[i] and found[j]["n_words"]], [0.25, 0.75], method="inverted_cdf")
            q1, q3 = quart[key]
            spread = max(q3 - q1, quality.SPREAD[k])
            high, low = q3 + quality.REACH * spread, q1 - quality.REACH * spread if k == "length" else -1.0
            inside &= low <= x <= high
            sure &= abs(x - high) > 0.12 * high and abs(x - low) > 0.12 * abs(low)
            seen[k] += not low <= x <= high
        if sure:
            checked += 1
            assert r["kept"] == (inside and not r["base_failed"]), i
    assert checked > 0.8 * len(found) and seen["symbols"] and seen["length"]
    most = {k: quality.REACH * v for k, v in quality.SPREAD.items()}
    assert 100 * most["repeats"] < quality.MOST_REPEATED and most["lines"] < 0.5


def test_op9_each_limit_rejects_and_adapts(spark):
    rng = random.Random(9)
    word = lambda n=6: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(n - 2, n + 3)))
    plain = lambda n=6: "\n".join(" ".join(word(n) for _ in range(10)) for _ in range(6))
    code = lambda: "\n".join(" ".join(word() + ("#" if rng.random() < 0.5 else "") for _ in range(10)) for _ in range(6))
    rows = [(i, plain(), "en", "a") for i in range(300)] + [(1000 + i, code(), "en", "code") for i in range(300)]
    line, many = plain().split("\n")[0], " ".join(word() for _ in range(11))
    bad = {
        "symbols": code(),
        "lines": "\n".join([line.split()[0]] * 3 + [x for x in plain().split("\n")] + [line.split()[0]] * 3),
        "repeats": f"{many} {plain()} {many} {word()}",
        "long words": plain(30),
        "short words": " ".join("ab"[k % 2] + "cd"[k % 3 % 2] for k in range(7)) + " " + " ".join(f"{a}{b}" for a in "efg" for b in "hijkl"),
    }
    rows += [(2000 + k, t, "en", "a") for k, t in enumerate(bad.values())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 gone_id", "'x' counted")
    found = {r["doc_id"]: r for r in quality.judge(frame).collect()}
    assert [k for k, name in enumerate(bad) if found[2000 + k]["kept"] or found[2000 + k]["base_failed"]] == []
    assert all(found[i]["kept"] for i in range(300)) and all(found[1000 + i]["kept"] for i in range(300))
    kept = quality.keep(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}


def test_op9_sketch_quantiles(spark):
    from pyspark.sql import functions as F

    frame = spark.range(1, 1001).select(F.lit("x").alias("k"), F.lit(1000).alias("n_words"), F.col("id").alias("n_symbols"), F.lit(0).alias("n_dup_lines"), F.lit(1).alias("n_lines"), F.lit(0).alias("n_repeat_words"), F.lit(5000).alias("word_chars"))
    parts = [quality.sketch(frame.where(F.col("n_symbols") % 2 == k), ["k"]) for k in (0, 1)]
    r = quality.quartiles(quality.merge(parts[0].unionByName(parts[1]), ["k"]), ["k"]).where("ratio = 'symbols'").first()
    assert abs(r["q1"] - 0.25) < 0.02 and abs(r["q3"] - 0.75) < 0.03 and r["rows"] == 1000


def test_op10_pieces_and_sequences(rows, docs):
    from tokenizers import Tokenizer

    lib, expected, total = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), set(), 0
    for i, r in docs.items():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected.add((i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = rows("op10_packing")
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found} == expected and len(found) == len(expected)
    by: dict = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 4096 and len(by) <= 1.02 * -(-total // 4096) + 1


@pytest.mark.parametrize("seed", range(4))
def test_op10_plan_of_many_lengths(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6.3, 1.2, 20_000).astype(int), 1, 4096)
    lengths[rng.random(len(lengths)) < 0.33] = 1365  # three fill a sequence but for one token
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan, used = packing.Plan(counts), Counter()
    for n, low, high, first, _, per in plan.rows:
        for s in (first + np.arange(high - low) // per).tolist():
            used[s] += n
    assert max(used.values()) <= 4096 and sum(used.values()) == int(lengths.sum()) and len(used) == plan.sequences
    assert len(used) <= 1.03 * math.ceil(lengths.sum() / 4096)


def test_op10_places_by_broadcast_and_by_join(spark, odd):
    path = vocabulary("word_bpe_49k.json")
    before = packing.BROADCAST_ROWS
    key = lambda r: str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]))
    first = sorted(map(key, packing.pack(odd, path).collect()))
    packing.BROADCAST_ROWS = 0
    try:
        assert sorted(map(key, packing.pack(odd, path).collect())) == first
    finally:
        packing.BROADCAST_ROWS = before


def test_odd_and_empty_tables(spark, odd):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None)], "doc_id long, toxic int")
    yes = F.lit(True)
    runs = {
        "op1": lambda d: substring.remove(d),
        "op2": lambda d: bpe.encode_decode(d, vocabulary("byte_bpe_50k.json"), with_ids=True),
        "op3": lambda d: simhash.components(d),
        "op4": lambda d: toxicity.score(d, labels),
        "op5": lambda d: ctw.score(d, yes),
        "op6": lambda d: matroska.round_trip(d),
        "op8": lambda d: language.predict(d, yes),
        "op9": lambda d: quality.judge(d),
        "op10": lambda d: packing.pack(d, vocabulary("word_bpe_49k.json")),
    }
    for name, run in runs.items():
        found = run(odd).collect()
        assert len({r["doc_id"] for r in found}) == 8, name
        assert len(found) == 9 if name != "op10" else len(found) > 9, name
        assert run(odd.limit(0)).collect() == [], name
    assert {r["doc_id"]: r["text"] for r in runs["op1"](odd).collect()}[6] == ""
    same = {r["doc_id"]: r["component_id"] for r in runs["op3"](odd).collect()}
    assert same[6] == 5 and same[3] == same[4] == 2
    assert len(wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect()) == 0
    assert matroska.packet_table(matroska.media_column(odd)).where("doc_id = 5").count() > 10
