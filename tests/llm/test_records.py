"""Per-record operators against brute force, round trips and hand-made corners."""

import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from usetrail.llm import chat, decontaminate, extract, packing, quality, secrets, sharding, tokens

SF = "/root/testdata/sf0.001"
#: Documents with columns whose names the operators use inside.
CLASH = "doc_id long, text string, record string, bucket int, `group` string, verdict string, contamination string, text_hash string, spans string, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n ", "word", "é" * 50, "long " * 30_000, "a b c\na b c\n\n a b c", "<|endoftext|> </s>"] + ["same text here"] * 5
    rows = [(None if i == 3 else i, t, "r", 1, "g", "v", "c", "h", "s", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[1], rows[-1]], CLASH).repartition(3)


@pytest.fixture(scope="module")
def prose(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same_rows(a, b):
    return Counter(tuple(r) for r in a.collect()) == Counter(tuple(r) for r in b.collect())


# ---- quality -------------------------------------------------------------------------


def brute_facts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {x for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for x in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_facts(prose, docs):
    for r in prose.select("text").collect() + docs.select("text").collect():
        assert quality.facts(r.text or "") == brute_facts(r.text or "")


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learnt = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)
    model = quality.train(docs, learnt)
    judged = docs.select("doc_id", quality.judged(docs, model).alias("v")).join(labels.join(learnt, "doc_id", "left_anti"), "doc_id")
    rows = judged.select("quality", "v.*").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.probability >= quality.KEEP_FROM for r in good]) > 0.95
    assert np.mean([r.kept for r in bad]) < 0.2
    clean = [r for r in rows if r.toxicity < quality.TOXIC_FROM]
    assert all(r.kept == (not r.base_failed and r.probability >= quality.KEEP_FROM) for r in clean)
    assert not any(r.kept for r in rows if r.toxicity >= quality.TOXIC_FROM)


def test_held_out_toxic_texts_go_and_clean_ones_stay(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.pmod(F.xxhash64(F.lit(99), "doc_id"), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~held_out))
    rest = labels.where(held_out).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    asked = docs.join(rest, "doc_id")
    rows = asked.select("quality", "toxic", quality.judged(asked, model).alias("v")).where("NOT v.base_failed").select("quality", "toxic", "v.*").collect()
    toxic, clean = [r.kept for r in rows if r.toxic == 1], [r.kept for r in rows if r.toxic == 0 and r.quality == 1]
    assert len(toxic) > 60 and np.mean(toxic) < 0.2 and np.mean(clean) > 0.98


def test_quality_corners(spark, docs):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 1)], "doc_id long, quality int, text int")
    model = quality.train(docs, labels)
    assert model is None and quality.train(docs.limit(0), labels.limit(0)) is None
    rows = docs.select("text", quality.judged(docs, model).alias("v")).select("text", "v.*").collect()
    assert len(rows) == 15 and all(r.kept == (not r.base_failed) for r in rows)
    assert all(r.base_failed for r in rows if not r.text or len(r.text) < 60)
    assert quality.good_documents(docs, labels).columns == docs.columns


# ---- decontamination -----------------------------------------------------------------


def test_blocks_of_the_benchmark_find_the_same(spark, prose):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = prose.select("doc_id", decontaminate.contamination(prose, bench).alias("c"))
    many = prose.select("doc_id", decontaminate.contamination(prose, bench, block_bytes=800).alias("c"))
    assert same_rows(one.selectExpr("doc_id", "to_json(c)"), many.selectExpr("doc_id", "to_json(c)"))
    assert one.where("size(c.runs) > 0").count() > 0


def test_spans_point_into_the_original(spark):
    body = "Éa! Who, was THE first (to) cross the—wide river in May? yes"
    bench = spark.createDataFrame(
        [(1, "who was the first to cross"), (10, "WIDE river"), (2, "river in"), (None, "yes"), (3, ""), (4, None), (2, "river in")],
        "item_id long, text string",
    )
    docs = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string")
    found = {r.doc_id: r.c for r in docs.select("doc_id", decontaminate.contamination(docs, bench).alias("c")).collect()}
    assert [body[s.start : s.end] for s in found[1].spans] == ["Who, was THE first (to) cross", "river in", "yes"]
    assert found[1]["items"] == ["1", "2"] and found[1].n_words == 12
    assert found[2].n_words == found[3].n_words == 0 and not found[2].runs
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3}


def test_an_empty_benchmark_hits_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert same_rows(decontaminate.decontaminated(docs, none), docs)


# ---- secrets -------------------------------------------------------------------------


def spans(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r.s for r in secrets.scan(docs).select("doc_id", secrets.joined("spans").alias("s")).collect()}


def test_base_spans(spark):
    found = spans(
        spark, 'é PassWord = "abc+12=" api_key:short token=abcdef', "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "CC",
        "0" * 23 + "g" + "a1" * 12, "token=token:abcdefgh", None, "", "secret:" + "f" * 30,
    )
    assert found == {0: "assign:2:21,assign:37:49", 1: "access:20:42", 2: "hex:24:48", 3: "", 4: "", 5: "", 6: "assign:0:37,hex:7:37"}


def test_weak_parts_need_their_complement(spark):
    name, key, place = "ID9" + "X7" * 8, "aB3" * 12, "https://db.example.org/x"
    far = " " * 300
    found = spans(spark, name, key, place, f"{name} {key}", f"{name}{far}{key}", f"{place} {key}", f"{place} {name} {key}", f"{name} password=hunter22")
    kinds = {i: [x.split(":")[0] for x in s.split(",") if x] for i, s in found.items()}
    assert kinds == {0: [], 1: [], 2: [], 3: ["identifier", "opaque"], 4: [], 5: ["opaque"], 6: ["endpoint", "identifier", "opaque"], 7: ["identifier", "assign"]}


def test_masked_keeps_rows_and_columns(spark, docs):
    assert same_rows(secrets.masked(docs), docs)
    one = docs.where("doc_id = 4").withColumn("text", F.lit("é token=abcdefgh, AKIA" + "Q" * 16 + "."))
    assert [r.text for r in secrets.masked(one.union(one)).collect()] == ["é [SECRET], [SECRET]."] * 2
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(docs.limit(0)).count() == 0


# ---- sharding ------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [2_000, 1 << 30])
def test_shards(spark, docs, prose, bucket_bytes):
    for table, shards in ((docs, 4), (prose, 40)):
        rows = sharding.external_shuffle(table, shards, bucket_bytes=bucket_bytes).collect()
        assert Counter(r.record.doc_id for r in rows) == Counter(r.doc_id for r in table.collect())
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(s, [])) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    assert rows[0].record.asDict().keys() == dict(prose.dtypes).keys()


def test_order_follows_from_seed_and_content(prose):
    def order(df, seed):
        return [(r.record.doc_id, r.shard, r.slot) for r in sharding.external_shuffle(df, 5, seed).orderBy("shard", "slot").collect()]

    assert order(prose, 1) == order(prose.repartition(7), 1) != order(prose, 2)


def test_offsets_over_many_buckets(spark):
    counts = spark.range(5000).select(F.col("id").alias("bucket"), (F.col("id") % 3).alias("n"))
    found = {r.bucket: r["first"] for r in sharding._offsets(counts).collect()}
    assert found == dict(zip(range(5000), np.concatenate(([0], np.cumsum(np.arange(5000) % 3)[:-1])).tolist(), strict=True))


def test_written_shards_are_read_back(spark, docs):
    made = sharding.external_shuffle(docs, 3)
    path = spark.conf.get("spark.sql.warehouse.dir") + "/test-shards"
    assert sharding.write_shards(made, path).count() == docs.count()
    assert sharding.write_shards(sharding.external_shuffle(docs.limit(0), 3), path).count() == 0


def test_long_runs_and_many_spans_are_scanned_in_time(spark):
    spans = [f"A{i:015d}" if i % 2 else f"{i:024x}" for i in range(20_000)]
    rows = [(1, "a" * 500_000), (2, "xY" * 250_000), (3, " ".join(spans)), (4, "h" * 400_000 + "http://x.y")]
    started = time.time()
    found = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - started < 40
    assert [(s.start, s.kind, s.end) for s in found[1].spans] == [(0, 2, 500_000)] and not found[2].spans and not found[4].spans
    places, at = [], 0
    for i, span in enumerate(spans):
        places.append((at, 4 if i % 2 else 2, at + len(span)))
        at += len(span) + 1
    assert [(s.start, s.kind, s.end) for s in found[3].spans] == places


# ---- tokens and packing --------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.default_path())
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def as_named():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_added_tokens_are_those_of_the_library(as_named):
    encode = tokens.encoder(tokens.default_path()).encode
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext", "it's\n\n日本 <|endoftext|>\n", ""):
        assert encode(text, added=True).tolist() == as_named.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(prose, docs, reference):
    encode = tokens.encoder(tokens.default_path())
    odd = ["a  b", " x ", "it's\n\n \t we'll  ", "日本  x", "\x1c \x85", "<|endoftext|>"]
    for text in odd + [r.text or "" for r in prose.union(docs.select(*[F.col(c) if c in docs.columns else F.lit(None).alias(c) for c in prose.columns])).collect()]:
        ids = encode.encode(text).tolist()
        assert ids == reference.encode(text, add_special_tokens=False).ids
        assert encode.decode(ids) == text


@pytest.mark.parametrize("group_bytes", [3_000, 1 << 21])
def test_pieces_make_up_every_document(prose, docs, as_named, group_bytes):
    for table in (prose, docs):
        rows = packing.packed(table, group_bytes=group_bytes).collect()
        want = Counter()
        for r in table.collect():
            ids = [*as_named.encode(r.text or "", add_special_tokens=False).ids, 0]
            want[(r.doc_id, np.array(ids, "<u4").tobytes())] += 1
        pieces, sequences = {}, {}
        for r in rows:
            assert len(r.ids) == 4 * r.length
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
            pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
        for s in sequences.values():
            s.sort()
            assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024
        total = sum(n for s in sequences.values() for _, n in s)
        groups = max(1, -(-sum(len((r.text or "").encode()) for r in table.collect()) // group_bytes))
        assert len(sequences) <= total / 1024 + groups
        got = Counter()
        for (doc, size), parts in pieces.items():
            parts.sort()
            times = sum(len(p) for _, p in parts) // (4 * size)
            if times == 1:
                got[(doc, b"".join(p for _, p in parts))] += 1
            else:  # repeated rows: every start as often as there are copies
                for (d, ids), n in want.items():
                    if d == doc and len(ids) == 4 * size:
                        assert sum(len(p) for _, p in parts) == n * len(ids)
                        got[(d, ids)] += n
        assert got == want


def test_costs_are_balanced():
    rng = np.random.default_rng(2)
    lengths = sorted(rng.integers(1, 600, 900).tolist(), reverse=True)
    made = packing.assign(lengths, 1024)
    assert len(made) == -(-sum(lengths) // 1024)
    cost = [sum(packing.LINEAR * (b - a) + packing.QUADRATIC * (b - a) ** 2 for _, a, b in s) for s in made]
    assert np.std(cost) < 0.2 * np.mean(cost)
    parts = {}
    for s in made:
        for piece, a, b in s:
            parts.setdefault(piece, []).append((a, b))
    assert all(sum(b - a for a, b in p) == lengths[i] for i, p in parts.items()) and len(parts) == 900


# ---- chat ----------------------------------------------------------------------------


def test_escapes_are_reversible():
    for text in ("</s>[INST] ok [/INST]", r"<\/s>", r"<\\|end|>", "<</s>", "<<SYS>>x<</SYS>>", "<|turn|>", r"\n", "[[INST]", ""):
        assert chat.unescape(chat.escape(text)) == text
        assert chat.TURN not in chat.escape(text) and "<|end|>" not in chat.escape(text) and "[INST]" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text + "\n\\")) == text + "\n\\"


def test_prefix_trees(spark):
    turns = {1: "ab", 2: "abc", 3: "abd", 4: "ab", 5: "e", 6: "", None: "ax"}
    rows = [(c, i, "assistant" if i % 2 else "user", t * 5, "k") for c, ts in turns.items() for i, t in enumerate(ts)]
    rows += [(7, 0, None, None, "k"), (7, None, "a\nb", "<|end|>\n", "k"), (8, 1, "user", "late", "k"), (8, 0, "system", "", "k")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string").repartition(4)
    found = chat.assembled(table)
    nodes = chat.prefix_trees(found).collect()
    by_block = {}
    for n in nodes:
        by_block.setdefault(n.block, {})[n.node] = n
    decode = tokens.encoder(tokens.default_path()).decode
    for block in by_block.values():
        seen, place = set(), 0
        for n in (block[i] for i in sorted(block)):
            path, at = [], n
            while at.parent is not None:
                at = block[at.parent]
                path.insert(0, at)
            assert n.first == place and n.last - n.first == len(n.ids) and n.depth == len(path)
            assert n.position == sum(len(p.ids) for p in path)
            attended = {x for i in n.attends for x in range(i["first"], i["last"])}
            assert attended == {x for p in path for x in range(p.first, p.last)}
            text = "".join(decode(p.ids) for p in [*path, n])
            assert text not in seen  # a shared turn stands once in a block
            seen.add(text)
            place = n.last
    shown = {r.conv_id: r for r in found.join(chat.read_back(chat.prefix_trees(found)), "digest").collect()}
    assert set(shown) == {1, 2, 3, 4, 5, 7, 8, None}
    assert shown[1].turns_sha256 == shown[4].turns_sha256 != shown[2].turns_sha256
    assert [t.role for t in shown[8].turns] == ["system", "user"] and shown[7].n_turns == 2
    assert shown[None].loss_chars == 5
    assert chat.read_back(chat.prefix_trees(chat.assembled(table.limit(0)))).collect() == []


# ---- pages ---------------------------------------------------------------------------


def test_main_text_of_pages():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Menu</a></ul></nav><!-- <p>no</p> --><div class="sidebar x"><p>side</p></div>
    <article><h1>Head &amp; more</h1><p><b>One<br>two &nbsp; three<p>Four<i>teen</i> &#233;<span class="ad">buy</span></p>
    <ul><li>a<li>b</ul><form><p>form</p></form><blockquote>q</blockquote><div class="comments"><p>me</p></div></article>
    <aside>x</aside><footer>&copy; f</footer>"""
    assert extract.main_text(page, set()) == "Head & more\n\nOne two three\n\nFourteen é\n\na\n\nb\n\nq"
    assert extract.main_text(None, set()) == extract.main_text("", set()) == extract.main_text("<p", set()) == ""
    assert extract.main_text("plain &lt;text&gt;", set()) == "plain <text>"


def test_wrappers_that_mention_noise_keep_their_article():
    for name in ("site has-sidebar", "no-sidebar", "content-sidebar-wrap", "comments-open", "notice"):
        page = f'<div class="{name}"><p>before</p><article><p>a <i class="ad">x</i>b</p></article></div>'
        assert extract.main_text(page, set()) == "before\n\na b"
    inside = '<article><section class="related-work"><p>a <span class="search-term">b</span></p></section></article>'
    assert extract.main_text(inside, set()) == "a b"
    assert extract.main_text('<div class="cookie-notice"><p>x</p></div><main>y</main>', set()) == "y"


def test_low_branches_of_a_site_go(spark):
    pages = [
        (i, f"http://h.example/{i}", f"<body><div class=top><p>Welcome all</p></div><div class=main><p>Story {i} a</p><p>Tale {i}</p></div><div class=end>The end</div></body>")
        for i in range(8)
    ]
    pages += [(90, "http://one.example", "<body><div>Only page</div></body>"), (91, None, None), (92, "", ""), (0, *pages[0][1:])]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    for sent in (100, 0):  # low branches sent to every task, and joined by host
        rows = extract.extracted(table, sent=sent).collect()
        texts = {r.page_id: r.text for r in rows}
        assert len(rows) == len(pages)
        assert texts[3] == "Story 3 a\n\nTale 3" and texts[90] == "Only page" and texts[91] == texts[92] == ""
    assert extract.extracted(table.limit(0)).collect() == []


def test_hosts():
    assert [extract.host_of(u) for u in ("HTTP://U@A.b:80/x", "a.b/c", "https://a.b?x", None)] == ["a.b", "a.b", "a.b", ""]


# ---- pages that earlier versions got wrong ---------------------------------------------


def texts_of(spark, pages):
    table = spark.createDataFrame([(n, u, h) for n, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract.extracted(table).collect()}


def test_an_article_under_two_addresses_stays(spark):
    menu = "<div class='x'><p>Home</p><p>About us</p></div>"
    page = f"<body>{menu}<div class='y'><p>First paragraph of the article, long enough.</p><p>And a second one, too.</p></div></body>"
    other = f"<body>{menu}<div class='y'><p>Another story with a text of its own, longer than the menu is.</p></div></body>"
    found = texts_of(spark, [("http://h.x/a", page), ("http://h.x/a?utm=1", page), ("http://h.x/b", other), ("http://h.x/c", other)])
    assert "First paragraph" in found[0] and "second one" in found[0] and found[0] == found[1]
    assert "Another story" in found[2]


def test_lists_and_tables_of_an_article_stay(spark):
    page = "<article><h1>T</h1><p>Para one.</p><ul><li>Item</li></ul><table><tr><td>Cell</td></tr></table></article>"
    assert set(texts_of(spark, [("http://h.x/a", page), ("http://h.x/b", page)]).values()) == {"T\n\nPara one.\n\nItem\n\nCell"}


@pytest.mark.parametrize("name", ["comment-list", "comments-area", "post-comments", "site-footer", "main-nav", "top-menu",
                                  "share-buttons", "ad-container", "cookie-bar", "left-sidebar", "sidebar-left", "related-posts"])
def test_names_of_noise_with_a_place_beside_them(name):
    assert extract.main_text(f"<body><div class='{name}'><p>No.</p></div><div><p>Yes.</p></div></body>", frozenset()) == "Yes."


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "content-sidebar-wrap", "comments-open", "related-work", "search-term", "main"])
def test_names_that_only_mention_noise(name):
    assert extract.main_text(f"<body><div class='{name}'><p>Yes.</p></div></body>", frozenset()) == "Yes."


def test_quotes_open_a_value_only_after_the_equals_sign():
    page = "<p><a title=don't>it</a> is Jim's <b id = 'x>y' title=\"a'b\">text</b> and <i don't>more</i></p>"
    assert extract.main_text(page, frozenset()) == "it is Jim's text and more"


def test_sharding_takes_columns_with_dots(spark):
    table = spark.createDataFrame([(n, f"text {n}") for n in range(50)], "`doc.id` long, `the.text` string")
    rows = sharding.external_shuffle(table, 3, key="doc.id", text="the.text").collect()
    assert sorted(r.record["doc.id"] for r in rows) == list(range(50)) and {r.shard for r in rows} == {0, 1, 2}


def test_deep_pages_take_time_in_proportion():
    page = "<div class='a'>x" * 60_000 + "</span>" * 60_000 + "<article>" * 500 + "<p>y" * 5_000
    started = time.time()
    text = extract.main_text(page, {5})
    assert time.time() - started < 20
    assert text.count("x") == 60_000 and text.count("y") == 5_000


def test_style_trees_equal_their_definition_at_any_depth(spark):
    def page(i, depth):
        deep = "".join(f"<div class='d{'ab'[k % 2]}'>" + (f"<p>note {i % 3}</p>" if k % 5 == 0 else "") for k in range(depth))
        return f"<body><div class='menu{'' if i % 2 else 's'}'><p>Home</p></div>{deep}<p>Text {i}</p>" + "</div>" * depth + "</body>"

    made = [(i, f"http://h{i % 2}/{i}", page(i, 3 + 4 * (i % 4))) for i in range(24)]
    table = spark.createDataFrame(made, "page_id bigint, url string, html string")
    got = {(r.host, r.node): r.importance for r in extract.style_trees(table).collect()}
    seen, pages, up = Counter(), Counter(), {}
    for _, url, html in made:
        host = extract.host_of(url)
        blocks, nodes = extract.parse(html)
        up.update({(host, n.number): (host, n.block.number) for n in nodes if n.block is not None})
        looks = {((host, n.number), False, tuple(n.children)) for n in nodes if n.children}
        texts = {((host, n.number), True, text) for n, text in blocks}
        seen.update(looks | texts)
        pages.update({key[:2] for key in looks | texts})
    shown, said = defaultdict(list), defaultdict(list)
    for (node, is_text, _), n in seen.items():
        (said if is_text else shown)[node].append(n)
    below = defaultdict(lambda: [0.0, 0])
    for node, counts in said.items():
        m, at = pages[node, True], node
        worth = 1.0 if m <= 1 else 1 - sum(map(math.log, counts)) / len(counts) / math.log(m)
        while at is not None:
            below[at][0] += worth * sum(counts)
            below[at][1] += sum(counts)
            at = up.get(at)
    want = {}
    for node, (weight, n) in below.items():
        want[node] = weight / n
        if node in shown:
            m, total = pages[node, False], sum(shown[node])
            own = 1.0 if m <= 1 else -sum(c / total * math.log(c / total) for c in shown[node]) / math.log(m)
            want[node] = (1 - extract.INHERIT) * own + extract.INHERIT * want[node]
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert min(want.values()) < extract.LOW < max(want.values())
