"""Detail pages and models' answers."""

import json
import random

import pytest

from offerlake.sources import answers, details


def quadratic(text):
    """The definition of the largest object: every start with every end."""
    found = []
    for start in (i for i, c in enumerate(text) if c == "{"):
        for end in range(len(text), start, -1):
            if text[end - 1] == "}":
                try:
                    json.loads(text[start:end])
                except ValueError:
                    continue
                found.append((start - end, start))
                break
    return None if not found else text[min(found)[1] : min(found)[1] - min(found)[0]]


def test_largest_object_by_hand():
    cases = {
        None: None,
        "": None,
        "no object": None,
        "{}": "{}",
        '```json\n{"a": 1}\n```': '{"a": 1}',
        "{what} {\"a\": [1, {\"b\": \"}\"}]} {helps}": '{"a": [1, {"b": "}"}]}',
        '{"cut": {"in": 1}, "never ends': '{"in": 1}',
        'It\'s "{" and {"a": "\\"{"}': '{"a": "\\"{"}',
        '{"a":"{"}":1}': '{"a":"{"}',
        '{"a":"{"}long":1}': '{"}long":1}',
        '{"a":01} {"b":1.5e-3,}': None,
        '{"a": true, "b": null} {"c": 0}': '{"a": true, "b": null}',
    }
    for text, want in cases.items():
        assert answers.largest_object(text) == want, text


def test_largest_object_against_its_definition():
    choose = random.Random(5)
    pieces = ["{", "}", "[", "]", ":", ",", '"', '"a"', '"k":', "1", "-2.5", "true", " ", "\\", '{"a":1}', '{"b":{', "x", "{}", '"}"', '"{"']
    for _ in range(6000):
        text = "".join(choose.choice(pieces) for _ in range(choose.randint(1, 14)))
        assert answers.largest_object(text) == quadratic(text), text


def test_long_noise_takes_linear_time():
    for noise in ("{" * 200_000, '{"a":' * 50_000, "[" * 200_000, '{"a":"' * 50_000, '{"a":[' * 40_000 + "}" * 40_000):
        assert answers.largest_object(noise + ' {"x": 1}') in ('{"x": 1}', '{"a":" {"x": 1}'), noise[:10]
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    assert answers.largest_object("so: " + deep + "}") == deep


def test_fields_of_odd_answers(spark):
    rows = [
        (1, '{"brewery_name_en": 5, "beer_name_en": ["x"], "product_type": null, "is_set": [], "queries": "one", "selected_index": "2"}'),
        (2, '{"brewery_name_en": "a", "brewery_name_en": "　b ", "is_set": {"x": 0}, "queries": [], "selected_index": 1.0}'),
        (3, None),
        (4, "[1, 2]"),
        (5, '```\n{"product_type": "set", "is_set": 0.0, "brewery_slug": "ABC"}```'),
        (6, 'said: {"product_type": "glass"}'),
    ]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "id int, answer string, reason string")
    got = {r.id: r for r in answers.read_answers(df).collect()}
    assert (got[1].producer_en, got[1].name_en, got[1].product_type, got[1].is_set, got[1].queries, got[1].selected_index) == (None, None, "beer", False, None, 2)
    assert (got[2].producer_en, got[2].is_set, got[2].queries, got[2].selected_index) == ("b", True, [], 1)
    assert got[3].object is None and got[3].is_set is None and got[4].product_type is None
    assert (got[5].product_type, got[5].is_set, got[5].inferred_slug) == ("set", False, "abc")
    strict = {r.id: r for r in answers.read_answers(df, noisy=False).collect()}
    assert strict[5].product_type == "set" and strict[6].object is None and got[6].product_type == "glass"
    assert answers.read_answers(df.limit(0)).count() == 0


def test_verdicts_of_a_model(spark):
    said = spark.createDataFrame([("u1", '{"selected_index": 1, "reason": "same"}'), ("u2", '{"selected_index": -1}'), ("u3", "none"), ("u4", '{"selected_index": 9}')], "url string, answer string")
    asked = spark.createDataFrame([(u, i, f"p{i}") for u in ("u1", "u2", "u3", "u4") for i in range(3)], "url string, pos int, product_url string")
    got = {tuple(r) for r in answers.verdicts(answers.read_answers(said), asked).collect()}
    assert got == {("u1", "p1", "same"), ("u2", None, None), ("u4", None, None)}


def test_selectors():
    page = "<div class='a b'><p id=x>one<span class=c>two</span></p></div><p>three<p>four<ul><li>5<li class=c>6</ul><img src=i.png><b>7"
    top = details.tree(page)
    texts = lambda s: [e.text() for e in top.select(s)]
    assert texts(".a.b p") == ["onetwo"] and texts("div .c") == ["two"] and texts("p") == ["onetwo", "three", "four"]
    assert texts("li") == ["5", "6"] and texts("ul li.c") == ["6"] and texts("[id=x]") == ["onetwo"] and texts("p[id] span") == ["two"]
    assert texts("*.c") == ["two", "6"] and texts("b") == ["7"] and texts("div div") == [] and top.first("img").attrs == {"src": "i.png"}
    for bad in ("", "a >> b", "a:hover"):
        with pytest.raises(ValueError):
            list(top.select(bad))


def test_malformed_and_deep_pages(spark):
    deep = "<div>" * 20_000 + "<div class=name><h1>deep</h1></div>"
    pages = [
        ("null", None), ("empty", ""), ("text", "just words < & >"), ("cut", "<div class='name'><h1>cut off"), ("cut in tag", "<div class='name'><h1>x</h1><p class='sty"),
        ("ends", "</div></p><div class='name'></b><h1> a <i> b </i></h1></div>"), ("twice", "<div class='name'><h1>1</h1></div><div class='name'><h1>2</h1></div>"),
        ("no number", "<div class='details'><p class='abv'>N/A ABV</p><p class='num'>(N/A)</p></div>"), ("deep", deep), ("deep", deep),
    ]
    df = spark.createDataFrame([(*p, "own style") for p in pages], "url string, html string, kind string")
    got = [(r.url, r.product_name, r.abv_value) for r in details.products(df, "https://x").collect()]
    names = {"cut": "cut off", "cut in tag": "x", "ends": "ab", "twice": "1", "deep": "deep"}
    assert sorted(got) == sorted((u, names.get(u), None) for u, _ in pages)
    assert details.producers(df).where("producer_name IS NOT NULL").count() == 6
    assert details.products(df.limit(0), "https://x").count() == 0
