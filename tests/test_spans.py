"""Positions: function ends, symbols and doc blocks against direct readings of the definitions."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_audit.operators import documentation, spans

BITS = ["{", "}", "'", '"', "`", "\\", "a", "\n", "function f(x)", "const g = (y) =>", "h(z) {", "async function", " ", "//", "/*", "*/", "(", ")", "=>", "const h = async (", "\u2028", "async "]


def end_by_scanning(text, start):
    """Walk character by character."""
    depth, quote = 0, None
    for i in range(start, len(text)):
        ch = text[i]
        if quote is None and ch in "\"'`":
            quote = ch
        elif quote is not None:
            if ch == quote and text[i - 1] != "\\":
                quote = None
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                return i + 1
    return len(text)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40).map("".join))
def test_body_ends(text):
    finder = spans.BodyFinder(text)
    for start in range(len(text)):
        if text[start - 1 : start] != "\\" or text[start] not in "\"'`":
            end = end_by_scanning(text, start)
            assert finder.end(start) == end, (text, start)
            closed = end < len(text) or text[-1:] == "}"
            assert closed or spans.BodyFinder(text, 5).end(start) in (end, min(start + 5, len(text)))


MARKS = [*BITS[:4], "function f(x) {", "}", "console.", "return", "this.", "let a", "var ", "import ", "import\n", "from", " ", "\n", "x", "fs.", "{"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(MARKS), max_size=30).map("".join), st.sampled_from([None, 20]))
def test_facts_equal_a_search_of_each_body(text, unclosed):
    finder, want = spans.BodyFinder(text, unclosed), []
    effect, local = spans._compile("|".join(spans.SIDE_EFFECTS)), spans._compile(spans.LOCAL_STATE)
    for start, _, _ in spans._BODY_HEADS.find(text, spans.Parentheses(text)):
        body = text[start : finder.end(start)]
        want.append({"has_effect": bool(effect.search(body)), "returns": "return" in body, "uses_this": "this." in body, "has_local_state": bool(local.search(body))})
    assert spans.body_facts(text, unclosed) == want


def test_nested_bodies_stay_cheap():
    """200,000 characters of functions within functions, closed and not."""
    for text in ("function a(){ " * 14_000 + "}" * 14_000, "function a(){\n" * 14_000, "import x " * 10_000 + "function a(){ " * 7_000):
        began = time.process_time()
        assert len(spans.body_facts(text)) >= 7_000 and len(spans.function_spans(text)) >= 7_000
        assert time.process_time() - began < 2


def hidden_by_counting(text, index):
    before = text[:index]
    if any(before.count(q) % 2 for q in "'\"`"):
        return True
    start = max(before.rfind("\n"), 0)
    return "//" in text[start:index] or before.rfind("/*") > before.rfind("*/")


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40).map("".join))
def test_hidden_and_lines(text):
    places = spans._Places(text)
    for index in range(len(text) + 1):
        assert places.hidden(index) == hidden_by_counting(text, index), (text, index)
        assert places.line(index) == text[:index].count("\n") + 1


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40).map("".join))
def test_heads_equal_the_plain_patterns(text):
    parentheses = spans.Parentheses(text)
    for fast, pattern in (
        (spans._BODY_HEADS, spans.BODY_FUNCTIONS),
        (spans._SIZED_HEADS, spans.SIZED_FUNCTIONS),
        (spans._ARROW_HEADS, spans.ARROWS),
    ):
        found = [(start, end) for start, end, _ in fast.find(text, parentheses)]
        assert found == [m.span() for m in spans._compile(pattern).finditer(text)]
    methods = [(m.start(), m.group(1)) for m in spans._compile(spans.METHODS).finditer(text)]
    assert list(spans._methods(text, parentheses)) == methods


def test_long_shapes_stay_cheap():
    """200,000 characters of each shape; quadratic reading takes many seconds."""
    for shape in ("function a(", "a(", "const a = (", "const a = async (", "/** ", "\n", "\n a(", "class a ", "function a() {"):
        text = shape * (200_000 // len(shape))
        began = time.process_time()
        spans.symbols_of(text)
        spans.function_spans(text + ")")
        spans.body_facts(text + ")")
        assert time.process_time() - began < 8, shape


def test_purity_and_sizes(files):
    code = (
        "function pure(a) { return a * 2; }\n"
        "function loud(a) { console.log(a); return a; }\n"
        "function local(a) { let b = a; return b; }\n"
        "function own() { return this.x; }\n"
        "function long(a) {\n" + "step(a)\n" * 30 + "}\n"
    )
    table = files({"a.js": code})
    row = spans.function_purity(table).first()
    # A bare call head such as "own() {" is matched by the declaration only; steps have no brace.
    assert (row["pure"], row["side_effects"], row["impure"]) == (1, 1, 3)
    ratio = spans.side_effect_ratio(spans.function_purity(table)).first()
    assert (ratio["high_side_effects"], ratio["side_effect_percentage"]) == (True, 50.0)
    sizes = [(r["head"], r["line"], r["lines"], r["is_large"]) for r in spans.function_sizes(table).collect()]
    assert ("function long", 5, 32, True) in sizes


CODE = '''/** One. */
export class Store extends Base {
  load(id) {
    return id;
  }
  getName() {
    return 1;
  }
}

// ------------------------------------------------------------------------------
// ------------------------------------------------------------------------------
// class Hidden
const s = "function inText";
/** Adds. */

async function add(a) {}
export const minus = (a, b) => a - b;
'''


def test_symbols_and_coverage(files):
    per_file = spans.file_symbols(files({"a.js": CODE, "b.md": CODE, "c.js": "plain"})).cache()
    found = {(r["name"], r["line"], r["kind"], r["gap"]) for r in documentation.symbols(per_file).collect()}
    assert found == {
        ("Store", 2, "class", 1),
        ("add", 17, "function", 2),
        ("minus", 18, "function", 3),
        ("load", 3, "method", 2),
        ("getName", 6, "method", 5),
    }
    assert sorted(r["line"] for r in documentation.docblocks(per_file).collect()) == [1, 15]
    scores = {r["path"]: (r["symbols"], r["documented"], r["score"]) for r in documentation.file_doc_scores(per_file).collect()}
    assert scores == {"a.js": (5, 3, 0.6), "c.js": (0, 0, 1.0)}
    cover = documentation.doc_coverage(documentation.file_doc_scores(per_file)).first()
    assert (cover["coverage"], cover["band"], cover["good_files"]) == (60.0, "good", 1)
    issues = documentation.file_doc_issues(per_file).collect()
    assert {r["description"] for r in issues} == {
        "Missing documentation for function `minus` (line 18)",
        "Missing documentation for method `getName` (line 6)",
    }
    # The join over tables and the distance inside a row say the same.
    symbols, blocks = documentation.symbols(per_file), documentation.docblocks(per_file)
    assert {r["name"] for r in documentation.documented(symbols, blocks).collect()} == {"Store", "add", "load"}
    assert {r["name"] for r in documentation.undocumented(symbols, blocks).collect()} == {"minus", "getName"}


def test_missing_text(files):
    table = files([("r", "a.js", None)])
    assert spans.function_purity(table).count() == 0
    assert documentation.file_doc_scores(spans.file_symbols(table)).first()["score"] == 1.0


def test_many_unclosed_functions_stay_cheap():
    text = "function f(a) { 'x " * 20_000
    assert len(spans.body_facts(text)) == 20_000 and len(spans.function_spans(text)) > 0


def test_declarations_are_found_as_by_their_patterns():
    import random

    rng = random.Random(5)
    words = ["export", "async", "class", "function", "x", "A1", " ", " ", " ", "\n", "\t", "(", "é", ";"]
    for _ in range(4000):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(25)))
        for core, before, pattern in ((spans._CLASS, ("export",), spans.CLASSES), (spans._FUNCTION, ("async", "export"), spans.FUNCTIONS)):
            assert list(spans._declared(core, before, text)) == [(m.start(), m.group(1)) for m in spans._compile(pattern).finditer(text)], text
