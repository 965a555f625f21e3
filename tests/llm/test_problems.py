"""The ten problems against brute force, hand-made cases and odd inputs."""

import itertools
import os
import random
import re

import numpy as np
import pytest

from corvine.llm import batches, languages, leakage, markup, neardup, neighbours, packing, queries, scans, sentences, splitting

W = re.compile(r"\w+")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 1


def lexicon():
    words = {w: 500 for w in "the quarterly report merges low-confidence half of results around cross-encoder candidates index".split()} | {"oil": 3, "all": 900}
    return scans.Lexicon(words, 10_000)


def test_scan_cases():
    text = "The quarter1y report rnerges the low-\nconfidence half of the candi¬\n- 12 -\nVexban Survey 3\ndates around the inde-\nx of oil, mergse"
    got = set(scans.cases(text, lexicon()))
    assert {(1, "char", "quarterly"), (1, "char", "merges"), (1, "hyphen", "low-confidence"), (2, "hyphen", "candidates"), (3, "furniture", ""), (4, "furniture", "")} <= got
    assert not [g for g in got if g[2] == "all" or g[0] == 6 and g[1] == "char"]  # a real word and a typist's slip stay


def test_scan_repair_joins_paragraphs():
    assert scans.repaired("The report of the candi-\n\n[7]\n\ndates merges\nthe index.\n\nThe half.", lexicon()) == "The report of the candidates merges the index.\n\nThe half."
    plain = "# Title\n- item one\n- item two\ndef f(x):\n    return x\nfoo | bar\n\nlow half of the report"
    assert scans.repaired(plain, lexicon()) == plain
    page = "The report of the half merges the results around\nthe candi-\ndates of the index.\n\n- item one of the report\n- item two\n\nHeading of it\nThe quarter1y report of the results merges the\nhalf of it.\n12\n"
    assert scans.repaired(page, lexicon()) == "The report of the half merges the results around the candidates of the index.\n\n- item one of the report\n- item two\n\nHeading of it\nThe quarterly report of the results merges the half of it."
    wide = "x" * 300
    even = "\n".join(["The half of the report around the quarterly index", "merges the half of the results around the candi-", "dates of the index and all of the half around the", "results, the report around the quarter1y index of", "it."])
    assert scans.repaired(f"{wide}\n\n{even}\n\n{wide}", lexicon()).split("\n")[2] == "The half of the report around the quarterly index merges the half of the results around the candidates of the index and all of the half around the results, the report around the quarterly index of it."
    assert scans.repaired(f"{wide}\n\nShort Heading 3\n\n{wide}", lexicon()) == f"{wide}\n\nShort Heading 3\n\n{wide}"
    assert {c[0] for c in scans.cases(f"{wide}\n{even}\n```\nquarter1y\n```", lexicon())} == {3, 5}
    assert scans.repaired(None, lexicon()) is None and scans.repaired("", lexicon()) == ""


def test_scan_frame(spark):
    df = frame(spark, [("a", None), ("b", ""), ("c", "x" * 5000), ("d", "12\n\n12")], "id string, text string").selectExpr("*", "id AS body", "1 AS k0")
    lex = scans.learn(df, "text")
    assert {tuple(r) for r in scans.scan_noise(df, ["id"], "text", lex).collect()} == {("d", 1, "furniture", ""), ("d", 3, "furniture", "")}
    assert scans.scan_noise(df.limit(0), ["id"], "text", lex).count() == 0


@pytest.mark.parametrize("share", [None, 0.01])
def test_scan_repairs_to_rare_words(spark, monkeypatch, share):
    if share:  # as in a corpus so large that these words are none of the frequent ones
        monkeypatch.setattr(scans, "KNOWN_SHARE", share)
        monkeypatch.setattr(scans, "INDEX_SHARE", share)
    filler = "\n".join(["all of the usual report was sent to the office"] * 100)
    names = "\n".join(["we saw the vexdruok was open"] * 5 + ["so did report ycxdruok of office"] * 6)
    page = "Then the vcxdruok was shut, and the l1m-\nhovvex too."
    rows = [("f", filler), ("n", names), ("n2", "to limhovvex\n" * 4), ("p", page), ("q", "x" * 200 + " vcxdruok"), ("e", "")]
    df = frame(spark, rows, "id string, text string")
    lex = scans.learn(df, "text")
    got = {tuple(r) for r in scans.scan_noise(df, ["id"], "text", lex).collect()}
    assert got == {("p", 1, "char", "vexdruok"), ("p", 1, "hyphen", "limhovvex")}
    clean = {r.id: r.clean for r in scans.repair_scans(df, ["id"], "text", lex).collect()}
    assert clean["p"] == "Then the vexdruok was shut, and the limhovvex too." and clean["q"] == rows[4][1] and clean["e"] == "" and len(clean) == 6


def test_deletes_meet_wherever_confusions_are():
    for (a, b), (c, d) in itertools.product(scans.CONFUSED, repeat=2):
        seen, meant = f"k{a}jk{c}s", f"k{b}jk{d}s"
        once = f"k{b}jk{c}s"
        assert scans.seen_deletes(once + "xx") & scans.meant_deletes(meant + "xx") and scans.seen_deletes(seen + "xx") & scans.meant_deletes(meant + "xx")
        assert a[0] != b[0] and a[-1] != b[-1] and scans.cost(seen, meant) == pytest.approx(scans.distance(seen, meant))
    assert scans.seen_deletes("cat") == {"\0at", "c\0t", "ca\0"} and scans.meant_deletes("jkx") == set()
    assert not scans.seen_deletes("mergse") & scans.meant_deletes("merges")


@pytest.mark.parametrize("size", [12, 16, 17, 18, 19, 20, 40, 5000])
def test_deletes_of_long_words_stay_few_and_meet(size):
    rng = random.Random(size)
    for _ in range(60 if size < 100 else 5):
        meant = "".join(rng.choice("aceimnrtuvwhlidjk") for _ in range(size))
        seen, at = meant, 0
        for _ in range(2):
            places = [(i, a, b) for i in range(at, min(at + size // 2 + 2, len(seen))) for a, b in scans.CONFUSED if seen.startswith(b, i)]
            i, a, b = rng.choice(places)
            seen, at = seen[:i] + a + seen[i + len(b) :], i + len(a)
            assert scans.seen_deletes(seen) & scans.meant_deletes(meant)
            assert seen == meant or scans.cost(seen, meant) <= scans.MOST_COST
        assert len(scans.seen_deletes(seen)) < 1000
    assert scans.Deletes({meant: 5}).near(seen, 4) == [meant]


def test_candidates_match_brute_force(spark):
    rng = random.Random(5)
    meant = {"".join(rng.choice("aceimnrtuvwhlid") for _ in range(rng.randint(2, 8))): rng.choice([3, 4, 30, 900]) for _ in range(400)} | {"vv1nd": 50, "m": 50}
    seen = set(list(meant)[:50])
    for w in list(meant) * 3:
        for _ in range(rng.choice([1, 2, 2])):
            a, b = rng.choice([(a, b) for a, b in scans.CONFUSED if b in w] or [("", "")])
            at = rng.choice([i for i in range(len(w)) if w.startswith(b, i)])
            w = w[:at] + a + w[at + len(b) :]
        seen.add(w)
    usable = {c: n for c, n in meant.items() if n >= scans.LEAST and len(c) > 1 and c.isalpha()}
    near = {w: {c for c in usable if c != w and scans.distance(w, c) <= (scans.MOST_COST if len(w) > 5 else scans.CONFUSION_COST + 0.05)} for w in seen}
    assert sum(map(len, near.values())) > 500
    index = scans.Deletes(meant)
    assert all({c for c in index.near(w, scans.LEAST) if c != w and scans.cost(w, c) <= scans.most_cost(w)} == near[w] for w in seen)
    counts = frame(spark, [x for x in meant.items() if x[1] >= scans.LEAST], "w string, n bigint")
    # With nothing below the usual count no candidate is doubtful.
    got = scans._candidates(frame(spark, [(w,) for w in seen], "w string"), counts, 0.0).collect()
    assert {r.w: {c.c for c in r.cands or ()} for r in got if r.cands} == {w: x for w, x in near.items() if x}


def test_scan_broadcasts_no_table(spark, tmp_path):
    """What comes to the driver doesn't follow the tables, which are small in files and large in rows."""
    rng = random.Random(3)
    usual = ["".join(rng.choices("abcdefghiklmnorstuvw", k=8)) for _ in range(400)]
    lines = [" ".join(rng.choices(usual, k=8)) for _ in range(1500)]
    rare = [w for w in usual if "m" in w][:50]
    rows = [(str(k), f"{lines[k]}\n{lines[k + 1]} {rare[k % 50].replace('m', 'rn', 1) if k < 100 else ''}\n{lines[k + 2]}\n{k}") for k in range(1400)]
    df = frame(spark, rows, "id string, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    n = scans.scan_noise(df, ["id"], "text", scans.learn(df, "text")).filter("kind = 'char'").count()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList(before, 1000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert n > 50 and plans and not [x for x in plans if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]


# 2

SAMPLES = {
    "en": "The cache returns the report and all of the results were stored in the index by the worker.",
    "fr": "Le cache renvoie le rapport et tous les résultats sont conservés dans l’index par le service.",
    "de": "Der Speicher liefert den Bericht und alle Ergebnisse werden von dem Dienst in dem Index abgelegt.",
    "es": "La caché devuelve el informe y todos los resultados se guardan en el índice por el servicio.",
    "pt": "O cache devolve o relatório e todos os resultados são guardados no índice pelo serviço.",
    "ru": "Кэш возвращает отчёт и все результаты сохраняются в индексе.",
    "zh": "缓存返回了报告并且所有结果都保存在索引中。",
    "ja": "キャッシュは報告を返し、すべての結果は索引に保存された。",
    "th": "แคชส่งคืนรายงาน ผลลัพธ์ทั้งหมดถูกจัดเก็บในดัชนี",
    "hi": "कैश रिपोर्ट लौटाता है और सभी परिणाम सूची में रखे जाते हैं।",
}


def test_languages(spark):
    rows = [(f"{x}{i}", x if i else x.upper() + "-X", t) for x, t in SAMPLES.items() for i in range(3)]
    df = frame(spark, rows, "id string, lang string, text string")
    p = languages.learn(df, "text", "lang", "id")
    for x, t in SAMPLES.items():
        assert [r[0] for r in languages.analyse_languages([t], p)[0]] == [x]
    mixed = SAMPLES["en"] + " " + SAMPLES["de"] + "\n\n# " + SAMPLES["ru"].rstrip(".") + "\n\n- Le rapport est ici."
    assert [r[0] for r in languages.analyse_languages([mixed], p)[0]] == ["en", "de"]
    odd = frame(spark, [("a", None, None), ("b", "", ""), ("c", "en", "heading only")], "id string, lang string, text string")
    assert languages.name_languages(odd, ["id"], "text", "lang", p).count() == 0


def test_distance_is_out_of_place():
    p = languages.Profiles({"en": {"th": 0, "he": 1, "e": 2}, "de": {"er": 0, "e": 1, "ch": 2}})
    words = ["the", "there", "xy"]
    own = [g for g, _ in sorted(languages.Counter(g for w in words for g in languages.ngrams(w)).items(), key=lambda x: (-x[1], p.ids.get(x[0], len(p.ids) + languages.zlib.crc32(x[0].encode()) % (1 << 22))))]
    for x, ranks in (("en", {"th": 0, "he": 1, "e": 2}), ("de", {"er": 0, "e": 1, "ch": 2})):
        want = sum(abs(i - ranks[g]) if g in ranks else languages.PROFILE for i, g in enumerate(own)) / len(own)
        assert p.distances([["zz"], words, []])[1][p.languages.index(x)] == pytest.approx(want)
    assert p.name_evidence(["", "the there"])[0][0] == "" and p.name_evidence(["the there"])[0][0] == "en"


# 3


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(40)]
    for t in list(texts):
        for n in (1, 2, 4, 8):
            x = t.split()
            for _ in range(n):
                x[rnd.randrange(len(x))] = rnd.choice(words)
            texts.append(" ".join(x))
    texts += [texts[0], texts[0].upper(), "short text", "", None]
    rows = [(f"c{i:03}", t) for i, t in enumerate(texts)] + [("c000", texts[0])]
    members, links = neardup.near_duplicates(frame(spark, rows, "id string, text string").selectExpr("*", "id AS item", "1 AS cls"), "id", "text", width=3, threshold=0.6, min_words=30)
    got = {tuple(r) for r in neardup.item_pairs(members, links).collect()}

    def sets(t):
        w = W.findall((t or "").lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 30 else set()

    s = {i: sets(t) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.6}
    assert got <= want and len(got) >= 0.97 * len(want)


def _pairs_by_walk(label, cls, depth, crowd):
    """The pairs and crowded members a trie should give, from its definition."""
    pairs, full = set(), set()

    def node(rows, d):
        for _, g in itertools.groupby(rows, key=lambda r: r[0] >> 8 * (neardup.LABEL - d)):
            g = list(g)
            if len(g) <= crowd:
                pairs.update((min(a, b), max(a, b)) for (_, a), (_, b) in itertools.combinations(g, 2) if a != b)
            else:
                full.update(c for _, c in g)
                if d < neardup.LABEL:
                    node(g, d + 1)

    node(sorted(zip(label, cls)), depth)
    return pairs, full


@pytest.mark.parametrize("piece", [1, 7, 50, 1000])
def test_trie_shortens_prefixes_of_small_nodes_only(piece):
    rng = np.random.default_rng(31)
    label = np.sort((rng.integers(0, 3, (600, 4)) @ np.array([1 << 32, 1 << 16, 1 << 8, 1])).astype(np.uint64))
    label[100:200] = label[100]
    label = np.sort(label)
    cls = np.arange(600, dtype=np.int64)
    want, full = _pairs_by_walk(label.tolist(), cls.tolist(), 3, 12)
    trie = neardup.Trie(3, 12, 0.5, 30)
    got = set()
    n, bits = np.full(600, 40, dtype=np.int32), np.zeros(600, dtype=np.uint64)
    for a in range(0, 600, piece):
        got |= set(zip(*(x.tolist() for x in trie.feed(label[a : a + piece], cls[a : a + piece], n[a : a + piece], bits[a : a + piece]))))
        assert len(trie.held[0]) <= 12 + piece
    got |= set(zip(*(x.tolist() for x in trie.feed(label[:0], cls[:0], n[:0], bits[:0], True))))
    assert {p for p in got if p[0] != p[1]} == want and {a for a, b in got if a == b} == full and want and full


def test_crowded_nodes_lose_no_pair(spark):
    rnd = random.Random(32)
    form = [f"f{i}" for i in range(60)]
    texts = [" ".join([*form, *(f"x{rnd.randrange(40)}" for _ in range(8))]) for _ in range(80)]  # one form, all alike
    rows = [(f"c{i:03}", t) for i, t in enumerate(texts)]
    members, links = neardup.near_duplicates(frame(spark, rows, "id string, text string"), "id", "text", width=3, threshold=0.8, crowd=5)
    s = {i: {tuple(w[k : k + 3]) for w in [t.split()] for k in range(len(w) - 2)} for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8}
    assert {tuple(r) for r in neardup.item_pairs(members, links).collect()} == want and len(want) > 50


def test_near_duplicates_of_nothing(spark):
    members, links = neardup.near_duplicates(frame(spark, [("a", None), ("b", "")], "id string, text string"), "id", "text")
    assert members.count() == links.count() == 0


def test_near_duplicate_groups_are_connected(spark):
    assert "p3_chunk_groups" in queries.QUERIES
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words[3 * k : 3 * k + 40]) for k in range(12)]  # neighbours are alike, the ends have nothing in common
    rows = [(f"c{k:02}", t) for k, t in enumerate(random.Random(3).sample(chain, 12))] + [("x", "some other text of no chain"), ("y", "短い"), ("z", "短い"), ("e", ""), ("f", ""), ("n", None)]
    df = frame(spark, rows + rows[:2], "id string, text string")
    members, links = neardup.near_duplicates(df, "id", "text", width=3, threshold=0.6)
    got = neardup.groups(df, "id", "text", members, links).collect()
    grp = {r.item: r.grp for r in got}
    assert len(got) == len(grp) == 18 and grp["n"] is None
    assert len({grp[f"c{k:02}"] for k in range(12)}) == 1 and grp["y"] == grp["z"] and grp["e"] == grp["f"]
    assert len({grp["c00"], grp["x"], grp["y"], grp["e"]}) == 4


# 4


def registry(rnd, n):
    rows = []
    for i in range(1, n + 1):
        h = {f"k{j}": f"{rnd.randrange(12):064x}" for j in range(rnd.randrange(1, 5))}
        fh = rnd.choice([f"{rnd.randrange(30):x}", f"SHA256:{rnd.randrange(30):X}", None])
        rows.append((i, (i * 4 // (n + 1)), rnd.choice(["p", "q", None]), f"f{i}", fh, None, None if rnd.random() < 0.2 else str(h).replace("'", '"'), "2031-01-01"))
    return rows + rows[: n // 10]


def brute_force(rows):
    import json

    seen, files, sets, out = {}, {}, {}, set()
    for i, b, c, _, f, _, h, _ in rows:
        f = re.sub("^sha256:", "", f.lower()).lstrip("0") or "0" if f else None
        seen[i] = (b, c, f, frozenset(x.lstrip("0") or "0" for x in json.loads(h).values()) if h else None)
    for i, (b, c, f, t) in sorted(seen.items(), key=lambda x: (x[1][0], x[0])):
        case = None
        if b:
            if f and (c, f) in files:
                case = (files[c, f], i, "exact")
            elif t:
                near = sorted((-len(t & u) / len(t | u), j) for j, (d, u) in sets.items() if d == c and len(t & u) / len(t | u) >= 0.5)
                case = (near[0][1], i, "near") if near else None
        if case:
            out.add(case)
        else:
            if f:
                files.setdefault((c, f), i)
            if t:
                sets[i] = (c, t)
    return out


@pytest.mark.parametrize("one_by_one", [False, True])
def test_batches_match_brute_force(spark, one_by_one):
    rows = registry(random.Random(4), 120)
    df = frame(spark, rows, "entry_id bigint, batch_id int, collection_id string, filename string, file_hash string, chunk_ids string, chunk_hashes string, ingested_at string").selectExpr("*", "1 AS acc")
    assert {tuple(r) for r in batches.check_batches(df, one_by_one=one_by_one).collect()} == brute_force(rows)
    if not one_by_one:
        assert batches.check_batches(df.limit(0)).count() == 0


@pytest.mark.parametrize("one_by_one", [False, True])
def test_batches_prefer_the_stronger_new_match(spark, one_by_one):
    hashes = lambda *x: str({f"k{i}": f"{n:064x}" for i, n in enumerate(x)}).replace("'", '"')
    new, late = range(5, 16), [*range(1, 5), *range(5, 10)]
    sets = [(1, 0, range(1, 9)), (2, 1, new), (3, 1, late), (4, 2, [*range(4, 15)])]
    sets += [(11, 0, range(101, 109)), (12, 1, range(105, 117)), (13, 2, range(105, 118)), (14, 2, [*range(103, 117)]), (15, 1, [*range(101, 113)])]
    sets += [(21, 0, range(201, 211)), (22, 1, range(206, 216)), (23, 2, range(203, 216))]
    rows = [(i, b, "p", f"f{i}", None, None, hashes(*x), "2031-01-01") for i, b, x in sets]
    df = frame(spark, rows, "entry_id bigint, batch_id int, collection_id string, filename string, file_hash string, chunk_ids string, chunk_hashes string, ingested_at string")
    want = brute_force(rows)
    assert (22, 23, "near") in want and len({x[0] for x in want}) > 2
    assert {tuple(r) for r in batches.check_batches(df, one_by_one=one_by_one).collect()} == want


def chain(n):
    hashes = lambda x: str({f"k{i}": f"{t:064x}" for i, t in enumerate(x)}).replace("'", '"')
    return [(1, 0, "p", "f", "abc", None, hashes([9999]), "2031-01-01")] + [(i, 1, "p", "f", None, None, hashes(range(3 * i, 3 * i + 9)), "2031-01-01") for i in range(2, n + 2)]


def test_batches_cost_the_driver_the_same_however_they_hang_together(spark):
    schema = "entry_id bigint, batch_id int, collection_id string, filename string, file_hash string, chunk_ids string, chunk_hashes string, ingested_at string"
    folder = batches.shared_dir(spark).removeprefix("file://")
    written = []
    for n in (2, 14):
        before = len(os.listdir(folder))
        assert {tuple(r) for r in batches.check_batches(frame(spark, chain(n), schema)).collect()} == brute_force(chain(n))
        written.append(len(os.listdir(folder)) - before)
    assert len(brute_force(chain(14))) == 7 and written[0] == written[1]


@pytest.mark.parametrize("one_by_one", [False, True])
def test_large_batches_settle_in_rounds(spark, monkeypatch, one_by_one):
    monkeypatch.setattr(batches, "BROADCAST_BYTES", -1)
    rows = registry(random.Random(24), 90) + [(i + 200, b + 3, "z", *r) for i, b, _, *r in chain(6)[1:]]
    df = frame(spark, rows, "entry_id bigint, batch_id int, collection_id string, filename string, file_hash string, chunk_ids string, chunk_hashes string, ingested_at string")
    assert {tuple(r) for r in batches.check_batches(df, one_by_one=one_by_one).collect()} == brute_force(rows)


def test_index_goes_on_from_its_folder(spark, tmp_path):
    rows = registry(random.Random(14), 120)
    schema = "entry_id bigint, batch_id int, collection_id string, filename string, file_hash string, chunk_ids string, chunk_hashes string, ingested_at string"
    e = batches.entries(frame(spark, rows, schema)).cache()
    path = f"file://{tmp_path}/index"
    index = batches.BatchIndex(spark, path=path, parts=4)
    index.build(e.filter("batch_id = 0"))
    got = {tuple(r) for r in index.step(e.filter("batch_id = 1")).collect()}
    for b in (2, 3):
        got |= {tuple(r) for r in batches.BatchIndex.open(spark, path).step(e.filter(f"batch_id = {b}")).collect()}
    assert got == brute_force(rows)
    (tmp_path / "index" / "sets" / "gen=000009_0.5_4").mkdir()  # a generation that was not completed
    again = batches.BatchIndex.open(spark, path)
    assert len(again.done) == 4
    part = batches.F.col("part")
    plan = again._folders(again._table("posts", "coll string, sid bigint, n int, pos int, tok bigint, part int"), [1, 2]).filter(part >= 0)._jdf.queryExecution().toString()
    assert "part" in plan.split("PartitionFilters")[1][:120]


# 5


def test_pieces_cover_and_overlap(spark):
    rnd = random.Random(5)
    long_ = " ".join("".join(rnd.choices("abcdé", k=rnd.randrange(1, 12))) + rnd.choice(["", "", ".", "\n\n"]) for _ in range(30_000))
    rows = [("a", long_), ("b", "x" * 5000), ("c", "y" * 1803), ("d", "z" * 1804), ("e", None), ("f", ""), ("a", long_)]
    got = {}
    for r in splitting.split_oversized(frame(spark, rows, "id string, text string").selectExpr("*", "1 AS part", "2 AS body"), ["id"], "text").collect():
        got.setdefault(r.id, []).append((r.piece_no, r.start_pos, r.end_pos))
    assert set(got) == {"a", "b", "d"}
    for i, n in (("a", len(long_)), ("b", 5000), ("d", 1804)):
        p = sorted(got[i])
        assert [x[0] for x in p] == list(range(1, len(p) + 1)) and p[0][1] == 0 and p[-1][2] == n
        assert all((e - s) // 4 <= 450 and e > s for _, s, e in p) and all(0 <= p[k][2] - p[k + 1][1] <= 323 for k in range(len(p) - 1))
    assert len(long_) > 3 * (1 << 16)  # several ranges
    whole = {n: splitting.Ranges(len(long_), 1803, 323, n, lambda a, b: long_[a:b]) for n in (1 << 16, 10**9)}
    assert [p[:2] for k in range(whole[1 << 16].parts) for p in whole[1 << 16].pieces(k)] == [(s, e) for _, s, e in sorted(got["a"])]
    one = whole[10**9].pieces(0)
    assert one[:5] == whole[1 << 16].pieces(0)[:5] and len(one) <= len(got["a"]) <= len(one) + 2 * whole[1 << 16].parts


def test_giant_file(spark, tmp_path):
    p = tmp_path / "x.txt"
    text = ("Zeile mit Umlauten äöü und so weiter. " * 7 + "\n\n") * 300 + "日本。" * 2000 + "日本" * 4000
    p.write_bytes(text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    raw = text.encode()
    got = sorted(tuple(r)[1:] for r in splitting.split_files(spark, [str(tmp_path)], range_bytes=20_000).collect())
    assert [x[0] for x in got] == list(range(1, len(got) + 1)) and len(raw) > 5 * 20_000
    assert got[0][1] == 0 and got[-1][2] == len(raw) and all(0 < e - s <= 1803 for _, s, e, _ in got)
    assert all(0 <= a[2] - b[1] <= 323 for a, b in zip(got, got[1:]))
    for _, s, e, _ in got:
        raw[s:e].decode()
    stops = [raw[s:e].decode()[-1] for _, s, e, k in got if k == splitting.SENTENCE and raw[s:e].decode().count("。") > 50]
    assert stops and set(stops) == {"。"}


# 6


@pytest.mark.parametrize(
    "text, want",
    [
        ("## A **b** c ##\n\n- x `y`\n- z\n\n```py\na_*b*\n```\n\nTake $x_1$.", {("residue", "markdown"), ("heading", "A b c"), ("list_item", "x y"), ("list_item", "z"), ("code", "a_*b*"), ("formula", "x_1")}),
        ("<h2>\n <a id='s'></a>T &amp; U</h2><ul><li>one<li><b>two</b></ul><pre><code>i &gt; 3</code></pre><math>a^2</math>", {("residue", "html"), ("heading", "T & U"), ("list_item", "one"), ("list_item", "two"), ("code", "i > 3"), ("formula", "a^2")}),
        ("== H [[x|y]] ==\n\n# '''one'''\n# two{{cite|z}}\n\n<source lang='a'>\n# no\n</source>", {("residue", "wiki"), ("heading", "H y"), ("list_item", "one"), ("list_item", "two"), ("code", "# no")}),
        ("\\subsection*{A \\textbf{b}~\\cite{c}}\n\n\\begin{itemize}\n  \\item x\\_1\n\\end{itemize}\n\n\\[ a \\le b \\]\n\n\\begin{verbatim}\n\\x\n\\end{verbatim}", {("residue", "latex"), ("heading", "A b"), ("list_item", "x_1"), ("formula", "a \\le b"), ("code", "\\x")}),
        ("A fee between $3 and $5, p < 0.3, file_a_b.md, *.x.\n- 12 -", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_markup(text, want):
    a = markup.analyse(text)
    assert {("residue", x) for x in a.languages} | set(a.elements) == want


def test_content_regions_leave_out_menus(monkeypatch):
    menu = "\n".join(f'<li><a href="/{x}">{x} page</a></li>' for x in ("Home", "About", "Contact", "Imprint", "Help"))
    crumbs = '<div class="b"><a href="/">Start</a> | <a href="/d">Docs</a> | <a href="/d/x">Index</a></div>'
    body = "\n".join(f"<p>The index of part {k} holds every chunk of the collection, as <a href='#{k}'>note {k}</a> explains at some length.</p>" for k in range(6))
    items = "<ul>\n<li>first <a href='#'>own item</a> of the text itself</li>\n<li>second</li>\n</ul>"
    page = f"{crumbs}\n<ul>\n{menu}\n</ul>\n<h1>Title</h1>\n{body}\n{items}"
    a = markup.analyse(page)
    assert {x for k, x in a.elements if k == "list_item"} == {"first own item of the text itself", "second"}
    clean = markup.clean_text(a)
    assert "Start" not in clean and "Imprint" not in clean and clean.count("at some length") == 6 and "# Title" in clean
    monkeypatch.setattr(markup, "content_lines", lambda lines: [True] * len(lines))
    assert "Imprint" in markup.clean_text(markup.analyse(page))


def test_markup_frame(spark):
    df = frame(spark, [(1, "# H\n\n*x*"), (2, None), (3, "plain")], "id int, text string").selectExpr("*", "'c' AS kind", "'d' AS body")
    assert {tuple(r) for r in markup.markup_elements(df, ["id"], "text").collect()} == {(1, "residue", "markdown"), (1, "heading", "H")}
    assert {tuple(r) for r in markup.strip_markup(df, ["id"], "text").collect()} == {(1, "# H\n\nx"), (2, None), (3, "plain")}


# 7


def test_neighbours_recall(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((150, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = np.concatenate([base, *[base[:100] + 0.02 * rng.standard_normal((100, 64)) for _ in range(3)], base[:5]]) * rng.uniform(0.1, 9, (455, 1))
    bad = [None, [0.0] * 64, [1.0] * 63, [float("nan")] * 64]
    rows = [(f"v{i:03}", [float(y) for y in e]) for i, e in enumerate(x)] + [(f"z{i}", e) for i, e in enumerate(bad)]
    df = frame(spark, rows + rows[:20], "id string, e array<float>").selectExpr("*", "id AS item", "1 AS cls")
    got = {(r.item, r.neighbour) for r in neighbours.nearest(df, "id", "e", k=10, floor=0.95).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - 9 * np.eye(len(u))
    want = {(rows[i][0], rows[j][0]) for i in range(len(u)) for j in np.argsort(-s[i], kind="stable")[:10] if s[i, j] >= 0.95}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)
    assert neighbours.nearest(df.limit(0), "id", "e", 10, 0.95).count() == 0


def test_probing_order_is_by_score():
    o = neighbours.probing_order(4, 20)
    assert o[0] == () and o[1] == (0,) and len(set(o)) == 20 and all(len({min(x, 7 - x) for x in s}) == len(s) for s in o)


# 8


def test_packing(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([0, 1, 5, 40, 100, 101, 250, None])) for i in range(500)] + [(7, 40)]
    got = packing.fill_containers(frame(spark, rows, "id bigint, n int").selectExpr("*", "1 AS item"), "id", "n", capacity=100, group_items=200).toPandas()
    used = got.groupby(["group_no", "container_no"]).n_tokens.sum()
    assert used.max() <= 100 and got.n_tokens.sum() == sum(n or 0 for _, n in rows)
    parts = got.groupby("item").size()
    assert set(parts[parts > 1].index) <= {i for i, n in rows if n and n > 100} | {7}
    sizes = np.array([n or 0 for _, n in rows if (n or 0) <= 100])

    def plain(sizes):
        room = []
        for n in sorted(sizes, reverse=True):
            for i, r in enumerate(room):
                if r >= n:
                    room[i] -= n
                    break
            else:
                room.append(100 - n)
        return len(room)

    assert packing.pack(sizes, 100).max() + 1 == plain(sizes)
    assert packing.fill_containers(frame(spark, [], "id bigint, n int"), "id", "n").count() == 0


# 9


def test_leaks_match_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(words, k=30))) for i in range(20)] + [(90, "too short"), (91, None)]
    docs = []
    for d in range(120):
        x = rnd.choices(words, k=50)
        i, n = rnd.randrange(20), rnd.choice([0, 9, 10, 15])
        at = rnd.randrange(15)
        x[20:20] = items[i][1].split()[at : at + n]
        docs.append((d, "—".join(x).upper()))
    docs += [(200, None), (201, ""), docs[0]]
    df, it = frame(spark, docs, "doc_id bigint, text string").selectExpr("*", "1 AS item"), frame(spark, items, "item_id bigint, text string")
    grams = lambda t, n: {tuple(w[i : i + n]) for w in [W.findall((t or "").lower())] for i in range(len(w) - n + 1)}
    want = {(d, i) for d, t in docs for i, q in items if grams(t, 10) & grams(q, 10)}
    assert {tuple(r) for r in leakage.find_leaks(df, it).collect()} == want
    edited = {tuple(r) for r in leakage.find_leaks(df, it, run=12, max_edits=2, sampled=5).collect()}
    assert {(d, i) for d, t in docs for i, q in items if grams(t, 12) & grams(q, 12)} <= edited
    assert leakage.find_leaks(df, it.limit(0)).count() == 0


@pytest.mark.parametrize("inserted, dropped, changed", [(2, 0, 0), (0, 2, 0), (1, 0, 1), (1, 1, 0), (0, 1, 1), (0, 0, 2), (3, 0, 0), (0, 3, 0)])
def test_leaks_with_edits(spark, inserted, dropped, changed):
    rnd = random.Random(19)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(13))) for i in range(60)]
    docs = []
    for i, t in items:
        x = t.split()
        at = sorted(rnd.sample(range(2, 11), inserted + dropped + changed), reverse=True)
        for n, k in enumerate(at):
            x[k : k + 1] = [x[k], "new"] if n < inserted else [] if n < inserted + dropped else ["other"]
        docs.append((i, " ".join(["before"] * (i % 3) + x + ["after"] * (i % 2))))
    df, it = frame(spark, docs, "doc_id bigint, text string"), frame(spark, items, "item_id bigint, text string")
    got = {tuple(r) for r in leakage.find_leaks(df, it, run=13, max_edits=2, sampled=5).collect()}
    assert got == ({(i, i) for i, _ in items} if inserted + dropped + changed == 2 else set())


# 10


def test_sentences(spark):
    parts = ["Dr. Bo met Al at noon.", "The cat sat on p. 3 of it.", '"Is it old?" asked the man.', "The cat ran; it hid.", "The sum was 3.5 at most.", "The end was near."]
    mixed = {i: random.Random(i).sample(parts, 6) for i in range(60)}
    rows = [(i, "\n\n".join(" ".join(p[k : k + 2]) for k in (0, 2, 4))) for i, p in mixed.items()]
    zh = "缓存很旧。“索引旧吗？”值班员问道。任务停止了！"
    th = "ระบบลบตาราง งานหยุดแล้ว ดัชนีเก่า"
    back = "任务停止了！“索引旧吗？”值班员问道。缓存很旧。"
    rows += [(100, "A Heading\n\nThe cat sat on it."), (101, " \n "), (102, None), (103, ""), (104, zh), (105, th), *((200 + k, x) for k in range(8) for x in (zh, back)[k % 2 : k % 2 + 1]), *((300 + k, " ".join(random.Random(k).sample(th.split(), 3))) for k in range(8))]
    df = frame(spark, rows, "id bigint, text string").selectExpr("*", "1 AS item")
    m = sentences.train(df, "text")
    got = {}
    for r in sentences.split_sentences(df, "id", "text", m).collect():
        got.setdefault(r.item, []).append(r.end_pos)
    text = dict(rows)
    cut = lambda i: [text[i][a:b].strip() for a, b in zip([0, *sorted(got[i])], sorted(got[i]))]
    assert set(got) == set(range(60)) | {100, 104, 105, *range(200, 208), *range(300, 308)} and cut(100) == ["A Heading", "The cat sat on it."]
    assert all(cut(i) == p for i, p in mixed.items())
    assert [e for e, *_ in sentences.slots(zh, 0, len(zh))] == [5, 12, 18] and [e for e, *_ in sentences.slots(th, 0, len(th))] == [11, 23]


def test_posteriors_are_those_of_all_paths():
    odds, turn = [3.0, -1.0, 0.5, 5.0], [1.0, 0.2, 0.6, 1.0]
    yes, no = (lambda o: 1 / (1 + np.exp(-o))), (lambda o: 1 / (1 + np.exp(o)))
    weight = {}
    for path in itertools.product((1, 0), repeat=4):
        w, before = 1.0, 1
        for o, t, y in zip(odds, turn, path):
            w *= (yes(o) * (t if before else 1.0)) if y else no(o)
            before = y
        weight[path] = w
    total = sum(weight.values())
    p, pairs = sentences.posteriors(odds, turn)
    for k in range(4):
        assert p[k] == pytest.approx(sum(w for x, w in weight.items() if x[k]) / total)
        before = lambda x: x[k - 1] if k else 1
        assert pairs[k] == pytest.approx(tuple(sum(w for x, w in weight.items() if before(x) and x[k] == y) / total for y in (1, 0)))


@pytest.mark.parametrize("side", ["latin", "chinese"])
def test_sentences_without_punctuation(spark, side):
    rnd = random.Random(21)
    if side == "latin":
        say = lambda: " ".join([rnd.choice(["The", "Every", "My"]), *(rnd.choice(["old", "red", "small", "cat", "index", "table", "near"]) for _ in range(rnd.randrange(3, 7))), rnd.choice(["again", "today", "there"])])
        join, mark = " ", ". "
    else:
        say = lambda: rnd.choice(["我们", "今天", "他的"]) + "".join(rnd.choice("缓存索引表格报告结果服务器") for _ in range(rnd.randrange(6, 11))) + rnd.choice(["完了", "好吗", "之中"])
        join, mark = "", "。"
    rows = [(i, mark.join(say() for _ in range(3)) + mark.strip()) for i in range(400)]
    m = sentences.train(frame(spark, rows, "id bigint, text string"), "text")
    parts = [say().lower() for _ in range(40)]
    text = join.join(parts)
    want = set(np.cumsum([len(x) + len(join) for x in parts]) - len(join))
    got = set(m.decide(text))
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
    assert m.decide("A Heading Of Few Words") == [22]
