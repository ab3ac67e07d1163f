import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import lines, mainbody, pairs, pieces, quality, residue
from textloom.llm.languages import language

PROSE = "The registrar counter in the old hall asks students to return the form with a photo card before the census date. "


def test_language():
    assert language("El comité de becas cancela el plan de estudios cuando abre el portal") == "es"
    assert language("Die Bibliothek erklärt die Warteliste vor dem Freitag und nach der Prüfung") == "de"
    assert language("The form is due at the end of the week") == "en"
    assert language("Hall 204") == language(None) == language("") == "und"


# lines ------------------------------------------------------------------------------------------------------------------


def rows_of(spark):
    note = "Copyright 2024   Example Services  "
    data = [(i, f"https://WWW.a.example:80/p{i}", f"# {PROSE}{i}\n{note.replace('2024', str(2000 + i))}\nbody text number {'x' * (i + 15)}\n{note.upper()}") for i in range(8)]
    data += [(100, "http://b.example/", note), (101, None, note), (102, "https://a.example/", None), (103, "https://a.example/", "")]
    return spark.createDataFrame(data, "rec_id long, url string, text string").withColumn("site", F.lit("clash"))


def test_repeated_lines(spark):
    found = lines.repeated_lines(rows_of(spark))
    assert sorted((r.id, r.line_no) for r in found.collect()) == sorted((i, k) for i in range(8) for k in (1, 3))
    assert lines.repeated_lines(rows_of(spark), least=9).count() == 0
    assert lines.repeated_lines(rows_of(spark).limit(0)).count() == 0


def test_blocks_and_cleaning(spark):
    data = [(i, "https://a.example/", f"start of the page {'q' * (i + 3)}\nshare this page with your friends\nsign up for the newsletter today\n{'own words ' * 3}{'z' * (i + 1)}\nall rights are reserved here") for i in range(9)]
    rows = spark.createDataFrame(data, "rec_id long, url string, text string")
    found = lines.repeated_lines(rows, with_line=True)
    b = {r.line: r.block for r in lines.blocks(found).collect()}
    assert len(b) == 3 and b["share this page with your friends"] == b["sign up for the newsletter today"] != b["all rights are reserved here"]
    clean = lines.without_repeated(rows, found).where("rec_id = 2").first()
    assert clean.clean_text == f"start of the page qqqqq\n{'own words ' * 3}zzz"


def test_blocks_pass_over_lines_that_do_not_count(spark):
    data = [(i, "https://a.example/", f"share this page with your friends\n\nshort\n# Heading of this part\nsign up for the newsletter today\n{'own words ' * 3}{'z' * (i + 1)}\nall rights are reserved here") for i in range(9)]
    found = lines.repeated_lines(spark.createDataFrame(data, "rec_id long, url string, text string"), with_line=True)
    b = {r.line: r.block for r in lines.blocks(found).collect()}
    assert len(b) == 3 and b["share this page with your friends"] == b["sign up for the newsletter today"] != b["all rights are reserved here"]


@pytest.mark.parametrize("url,host", [("HTTP://www.A.example:8080/x", "a.example"), ("a.example/x", "a.example"), ("//www.b.example?q", "b.example"), ("", None), (None, None)])
def test_host(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(lines.host(F.col("u"))).first()[0] == host


# residue ----------------------------------------------------------------------------------------------------------------

SLOTS = ["{{ page_title }}", "{%name%}", "${startDate}", "#{term}", "<%= fee %>", "%%FEE_AMOUNT%%", "*|FIRST_NAME|*", "!!phone!!", "[[Contact Email]]", "[Insert name here]", "[your building]", "[START DATE]", "<first name goes here>", "&lt;start_date&gt;", "(enter page title)", "TODO: add deadline", "__TERM__", "XX office phone XX"]


@pytest.mark.parametrize("slot", SLOTS)
def test_slots(slot):
    assert residue.kinds("A title", f"{PROSE}{slot} {PROSE}") == ["placeholder"]
    assert residue.kinds(slot, None) == ["placeholder"]
    assert residue.kinds(None, f"{PROSE}`{slot}` {PROSE}") == []
    assert residue.kinds(None, f"In the template syntax, {slot} marks a variable. {PROSE}") == []


@pytest.mark.parametrize("text", ["In set notation, {a, b} denotes a pair.", ".a-1{margin:3px;color:#111}\n.b-2{margin:1px}", "[Privacy Notice](https://a.example/p)", "#### DATES\n\n### ALSO", "<td>Name</td><td>3</td>", "Room 404 is not available on Fridays, so the office moves. " + PROSE * 5])
def test_no_residue(text):
    assert residue.kinds("404 reasons to enrol", text) == []


def test_messages_and_filler():
    assert residue.kinds("x", "404\n\nWe looked in a and b but that address leads nowhere.") == ["error_page"]
    assert residue.kinds("x", "Please enable JavaScript to view the page.") == ["script_notice"]
    assert residue.kinds("x", f"# Heading\n{PROSE}\nLorem ipsum dolor amitor veniam officis irurem magnis aliqua consecta.") == ["filler"]
    assert residue.kinds("Page not found", PROSE) == []


def test_residue_frame(spark):
    rows = spark.createDataFrame([(1, "{{ t }}", None, "e"), (2, None, None, "e"), (3, None, "Access denied.", "e"), (3, None, "Access denied.", "e")], "rec_id long, title string, text string, kind string")
    found = residue.residue(rows)
    assert sorted(map(tuple, found.collect())) == [(1, "placeholder"), (3, "error_page"), (3, "error_page")]
    assert [r.rec_id for r in residue.without_residue(rows, found).collect()] == [2]
    assert residue.residue(rows.limit(0)).count() == 0


MESSAGES = ["The page no longer exists.", "This page is no longer available.", "Your session has timed out.", "The site is offline for upgrades.", "Die Seite ist nicht verfügbar.", "Page non trouvée.", "Cookies must be enabled.", "Página não disponível.", "Just a moment"]
COPY = ["Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi aliquip ea commodo consequat.", "Viverra pulvinar ornare egestas porttitor vexa.", "Your copy goes here"]


def test_prefilters_pass_what_the_rules_accept(spark):
    texts = MESSAGES + COPY + [f"{PROSE}{x} {PROSE}" for x in [*SLOTS, "[\u00a0Insert name here]", "!!\tphone!!", "(\u2009enter page title)"]]
    want = [(i, kind) for i, t in enumerate(texts) for kind in residue.kinds(None, t)]
    assert {i for i, _ in want} == set(range(len(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "rec_id long, text string").withColumn("title", F.lit(None).cast("string"))
    assert sorted(map(tuple, residue.residue(rows).collect())) == want


# pairs ------------------------------------------------------------------------------------------------------------------

Q = "What fee do seniors pay for career coaching at the college?"
VERDICTS = {
    None: "empty", " \n": "empty", "[no answer]": "empty", "**Answer:**": "empty", "N/A": "empty", Q: "copied_question", Q.upper(): "copied_question", f"Q: {Q}\nA: {Q}": "copied_question", f"“{Q}”": "copied_question",
    "I cannot answer this question.": "refusal", "Thanks. I won't be able to assist with this request": "refusal", "Le tarif est de 764 dollars, payable en 2 fois.": "other_language", "It costs 302 dollars,": "truncated", "The fee is paid in the": "truncated",
    "- Grade average\n-": "truncated", "302 dollars": None, f"{Q} It costs 302 dollars, payable in 3 instalments.": None, "I'm sorry to hear about the delay. It costs 302 dollars.": None, "We cannot refund this later. The fee is 30 dollars.": None,
}


def test_verdicts():
    assert {a: pairs.judge(Q, a) for a in VERDICTS} == VERDICTS
    assert pairs.judge(None, Q) is None


def test_endings_come_from_the_table(spark):
    rows = [(1, Q, "The fee is paid by seniors who visit the main office", "Fine, as the page says."), (2, Q, "The fee is due when they visit the main office.", "Fine."), (3, Q, "The fee is paid by seniors who visit the mai", None), (4, None, None, "Fine.")]
    df = spark.createDataFrame(rows, "raft_id long, question string, answer string, thought_process string")
    assert sorted(map(tuple, pairs.defects(df).collect())) == [(3, "answer", "truncated"), (3, "thought_process", "empty"), (4, "answer", "empty")]
    assert pairs.defects(df.limit(0)).count() == 0


def test_more_defects():
    assert pairs.judge("Where can I get help with tutoring?", "Allez au pavillon Ruskoltton, salle 316, ouvert jusqu'à 1 heures.") == "other_language"
    assert pairs.judge("Where can I get help with tutoring?", "Thanks for asking. No answer can be given by me here.") == "refusal"
    assert pairs.judge("Where can I get help with tutoring?", "The desk cannot refund this later.") is None
    assert pairs.judge("Who teaches it?", "Professor Arloltmont, Istarvvale Hall, 5 credits") is None
    assert pairs.align(pairs._COMPILED[0], "i really NOT at all answer that".split()) == 3 and pairs.align(pairs._COMPILED[0], "i NOT a b c d answer".split()) is None


def test_subsequence():
    assert pairs.common_subsequence("a b c b d".split(), "b d c a b a".split()) == 3
    assert pairs.common_subsequence([], ["a"]) == 0


# pieces -----------------------------------------------------------------------------------------------------------------


def test_pieces_rebuild_the_text():
    for text in (PROSE * 60, "x" * 5000, "word " * 900, "\n\n".join([PROSE * 3] * 12), "é" * 1999 + " " + "y" * 400, " " * 4500):
        spans = pieces.spans(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < b - a <= 2000 for a, b in spans)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c < d and 0 <= b - c <= 200
    assert [b - c for (_, b), (c, _) in zip(*(lambda s: (s, s[1:]))(pieces.spans("x" * 5000)))] == [200] * 2
    assert pieces.spans("short") == [(0, 5)]


def test_pieces_end_at_boundaries():
    text = ("Apples grow on old trees near the orchard wall. " * 25 + "\n\n" + "Engines burn fuel inside steel cylinders quickly. " * 30).strip()
    a, b = pieces.spans(text)[0]
    assert text[a:b].rstrip().endswith("wall.") and text[b - 1] == "\n"


def test_pieces_frame(spark):
    df = spark.createDataFrame([(1, "a " * 1500), (2, "b"), (3, None), (4, "")], "rec_id long, text string")
    assert sorted((r.id, r.piece_no) for r in pieces.pieces(df).collect()) == [(1, 0), (1, 1)]
    assert sorted(r.id for r in pieces.pieces(df, oversized_only=False).where("piece_no = 0").collect()) == [1, 2, 4]


# main body and quality --------------------------------------------------------------------------------------------------


def page(i):
    nav = "\n".join(("Home", "About", "Calendar", "Library", "Housing", "Contact"))
    own = "abcdefghijklmnopqrstuvwxyz"[i % 26] * (2 + i // 26)  # pages of one site have bodies of their own
    prose = PROSE.replace("registrar", own).replace("photo", f"{own}er")
    body = f"## Section {i}\n{prose}{prose}\n- Renew the card at Hall {i}.\n- Return the form at Hall {i + 1}.\n{prose.replace('form', own)}"
    return f"Skip to content\n{nav}\nYou are here: Home / Page\nCookies help us count visits.\nAccept all\n{body}\nShare this page\n© {2000 + i} Example University\n{i} Mill Road, Town | Phone (555) 555-0{i:03d}", set(range(10)), set(range(15, 18))


@pytest.fixture(scope="module")
def model():
    made = [page(i) for i in range(60)]
    return mainbody.fit([m[0] for m in made], ["https://a.example/"] * 60)


def test_labels_come_from_repetition():
    made = [page(i) for i in range(12)]
    one = mainbody.Lines.of([m[0] for m in made], ["https://a.example/"] * 12)
    label = mainbody.repetition_labels(one, ["a.example"] * 12)
    want = [k in made[r][1] | made[r][2] for r, k in zip(one.row.tolist(), one.number.tolist())]
    assert all(bool(x) == w for x, w in zip(label.tolist(), want) if x >= 0) and (label >= 0).mean() > 0.8
    apart = mainbody.repetition_labels(one, [f"{i}.example" for i in range(12)])
    assert not (apart == 1).any()  # nothing repeats within these sites


def test_pages_that_do_not_fit_are_left_out_alone():
    good = "<main><h1>Title</h1><p>Some own text of the page.</p></main><footer><p>All rights are held.</p></footer>"
    texts = [page(i)[0] for i in range(20)]
    assert mainbody.fit(texts, ["https://a.example/"] * 20, [(good, None)] * 3).dropped_pages == 0


def test_training_takes_sites_of_several_rows(spark):
    rows = [(i, page(i)[0], "https://a.example/x", None) for i in range(40)] + [(100 + i, PROSE, f"https://s{i}.example/", None) for i in range(60)] + [(200, PROSE, None, None)]
    df = spark.createDataFrame(rows, "rec_id long, text string, url string, source_type string")
    assert mainbody.train(df, None, most_rows=30, most_hosts=5) is not None
    assert mainbody.train(df.where("rec_id >= 100"), None, most_rows=30, most_hosts=5) is not None
    assert mainbody.train(df.limit(0), None) is None


def test_furniture(spark, model):
    made = [page(i) for i in range(70, 90)]
    df = spark.createDataFrame([(i, m[0], "https://a.example/", None) for i, m in enumerate(made)] + [(90, made[0][0], None, "pdf"), (91, None, None, None), (92, "", None, "web")], "rec_id long, text string, url string, source_type string")
    got = {(r.id, r.line_no) for r in mainbody.furniture(df, model).collect()}
    want = {(i, k) for i, m in enumerate(made) for k in m[1] | m[2]}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    bodies = {r.id: r.body for r in mainbody.main_bodies(df, model).collect()}
    assert bodies[0].startswith("## Section 70") and bodies[90] == made[0][0] and bodies[91] is None and bodies[92] == ""
    assert mainbody.furniture(df, None).count() == 0


def test_decoding_is_consistent():
    import numpy as np

    block, row = np.array([0, 0, 0, 1, 1, 2]), np.array([0, 0, 0, 0, 0, 1])
    odds = np.array([5.0, 4.0, -0.2, -5.0, -4.0, 3.0])
    hit = mainbody.decode(odds, np.array([4.0, -4.0, 3.0]), block, row)
    assert hit.tolist() == [True, True, True, False, False, False]  # the second row has no body otherwise


KINDS = {
    "list": "\n".join(f"- Meal Plans, Town{i}" for i in range(8)), "table": "\n".join(f"| MAT {i} | Hall {i} | {i * 3} | 10.00 |" for i in range(8)), "junk": "\n".join(f"var a{i}=function(a,b){{return a[{i}]||b;}};" for i in range(6)),
}


def kind_of(text):
    import numpy as np

    one = mainbody.Lines.of([text], [None])
    shares, _ = quality.body_shares(one, np.zeros(len(one.row), bool), 1)
    return quality.KINDS[shares[0].argmax()] if shares[0].sum() >= 0.5 else "prose"


def test_kinds():
    for kind, text in KINDS.items():
        assert kind_of(text) == kind
    for text in (PROSE * 3, (PROSE * 3).upper(), re.sub(r"[.,]", "", PROSE * 3).lower(), "Die Bibliothek erklärt die Warteliste vor dem Freitag, um einen Aufschlag zu vermeiden, wie mit dem Dekan vereinbart."):
        assert kind_of(text) == "prose"
    assert kind_of("Tour panel hall 58 " * 12) == "junk"
    words = [f"{a} {b}" for a in ("fees", "hall", "audit", "grants") for b in ("verum", "noldal", "quinut", "vosta", "fasley")]
    assert kind_of(" ".join(words)) == "junk" and kind_of(", ".join(words)) == "list"


def test_repeated_function_words_are_junk():
    for text in ("the office is open " * 40, "error in the log of the server " * 60, "\n".join(["the office is open to the public in the morning"] * 9)):
        assert kind_of(text) == "junk"


LINES = {
    "The list of the forms for the office of the dean . . . . . . 12": "list", "List of the forms for the office of the dean ______ 12": "list", "ii. the form of the office and the list of the dean": "list",
    "An x y z a b c d e f g h the of and with": "junk", "In the hall of the dean and of the office #### @@@@ //// %%%% ==== ++++ ~~~~ ^^^^": "junk",
    "The key of the office is with the dean Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4MTIz": "junk",
    "Fee of hall,302,Hall,dues,north,senior,with desk": "table", "Fees for the hall 302 405 118 77 12 9 31": "table", "Dean hall  north wing for  the senior desk": "table",
}


@pytest.mark.parametrize("line,kind", LINES.items())
def test_rules_apply_to_lines_with_function_words(line, kind):
    assert quality.line_kind(line) == kind_of(line) == kind


def test_not_prose(spark):
    rows = [(i, None, f"{PROSE * (2 + i % 4)}", "pdf") for i in range(60)] + [(100 + k, None, t, "pdf") for k, t in enumerate(KINDS.values())] + [(200, None, None, "pdf"), (201, None, "", "pdf"), (202, None, "Hall 3", "pdf")]
    df = spark.createDataFrame(rows, "rec_id long, title string, text string, source_type string").withColumn("url", F.lit(None).cast("string")).withColumn("score", F.lit(1))
    scored = quality.scored(quality.profile(df, None))
    assert {r.id: r.kind for r in quality.not_prose(scored).collect()} == dict(zip((100, 101, 102), KINDS))
    assert scored.where("id = 200").first().score is None


def test_the_score_decides(spark):
    """A body of 0.4 list is a case only where the other statistics are outliers too; its share alone, below the bar, is not."""
    mixed = f"{PROSE}\n" + "\n".join(f"- Meal Plans, Town{i}" for i in range(5))
    odd = "The registrar counter in the old hall asks students to return the form with 99 98 97 # % & * 55 44 $ 33 22 the photo card\n" + "\n".join(f"- Meal Plans, Town{i}" for i in range(5))
    lists = [f"{PROSE}\n" + "\n".join(f"- Meal Plans, Town{i + k}" for i in range(5 + k % 9)) for k in range(60)]
    rows = [(i, None, PROSE * (1 + i % 40), "pdf") for i in range(400)] + [(1000 + k, None, t, "pdf") for k, t in enumerate(lists)] + [(2000, None, mixed, "pdf"), (2001, None, odd, "pdf")]
    df = spark.createDataFrame(rows, "rec_id long, title string, text string, source_type string").withColumn("url", F.lit(None).cast("string"))
    scored = {r.id: r for r in quality.scored(quality.profile(df, None)).collect()}
    assert 0.4 < scored[2000].list_share < 0.5 and 0.4 < scored[2001].list_share < 0.5
    assert scored[2000].kind is None and scored[2001].margin > scored[2000].margin
    assert all((r.kind is not None) == (r.margin >= 0) for r in scored.values())


def test_frequent_texts_are_found_too(spark):
    for kind, text in KINDS.items():
        rows = [(i, None, PROSE * (1 + i % 3), "pdf") for i in range(40)] + [(100 + i, None, text, "pdf") for i in range(40)]
        df = spark.createDataFrame(rows, "rec_id long, title string, text string, source_type string").withColumn("url", F.lit(None).cast("string"))
        found = quality.not_prose(quality.scored(quality.profile(df, None)))
        assert sorted(map(tuple, found.collect())) == [(100 + i, kind) for i in range(40)]


def test_ranks_equal_brute_force(spark):
    from textloom.llm.ranks import running

    data = [(f"g{i % 3 and 1}", float(i % 7), i % 5, i) for i in range(300)]
    df = spark.createDataFrame(data, "g string, v double, w long, id long").repartition(7)
    for r in running(df, "g", ["v", "id"], "w", 6).collect():
        ahead = sum(w for g, v, w, i in data if g == r.g and (v, i) < (r.v, r.id))
        assert (r.before, r.total) == (ahead, sum(w for g, _, w, _ in data if g == r.g))


def test_messages_of_any_length():
    page = "404\n\nThe page you asked for could not be found. It may have been moved or removed. Please check the address and try again. "
    advice = "If the problem goes on, please contact the help desk with the reference number. Return to the home page or use the search box. The server reported: page not found. "
    for text in (page, page + advice * 2, page + advice * 30, "Please enable JavaScript in your browser. Scripts are required to view this page. " * 40):
        assert residue.kinds("x", text) in (["error_page"], ["script_notice"]), text[:80]
    assert residue.kinds("x", page + PROSE * 3) == []


@pytest.mark.parametrize("slot", ["@Model.PageTitle", "«Department Name»", "&lt;building&gt;", "to {1} the"])
def test_more_slots(slot):
    assert residue.kinds(None, f"{PROSE} {slot} {PROSE}") == ["placeholder"]
    assert residue.kinds(None, f"{PROSE} mail@Model.example <td>cell</td> &lt;span&gt; \\d{{2}} {PROSE}") == []


def test_filler_in_other_words():
    assert residue.kinds(None, f"{PROSE}\nTexto de ejemplo para Thoroltmont; aquí va el contenido definitivo. Dummy heading 2. Dummy paragraph for Orluridge, to be written.") == ["filler"]
    assert residue.kinds(None, "Dolor sit amet consectetur.") == ["filler"]


def test_wide_patterns_match_wherever_the_exact_ones_do():
    assert residue._wide(r"(?<![\w.@/])a(?!\()[\[\s](?:b|\w)\b") == r"a[\[\s\pZ\pC](?:b|[\w\pL\pN])"
    assert residue._wide(r"x(?=[A-Z _\-]{4,40}\])[^\]\s]y") == r"x[^\]\s\pZ\pC]y"
