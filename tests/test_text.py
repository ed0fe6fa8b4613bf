import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.operators.text import ROOT, Tree, apply_edit, deletions, diff_text, is_empty, merge_texts, render_text, segments, single, size, update


class Doc:
    def __init__(self):
        self.tree, self.texts, self.tx = Tree(), {}, 0

    def edit(self, upd, tx=None, sender="a"):
        self.tx = self.tx + 1 if tx is None else tx
        self.tree.apply((self.tx, 0, sender), upd)
        self.texts = apply_edit(self.texts, (self.tx, 0, sender), upd)
        return [(self.tx, 0, k, sender) for k in range(len(upd["new_anchors"]))]

    def text(self):
        return render_text(self.tree, self.texts)


def doc(*strings):
    d = Doc()
    d.edit(update([(ROOT, 0)] * len(strings), strings))
    return d


def test_siblings_read_newest_first():
    assert doc("first", "second").text() == "secondfirst"
    assert doc("мир ", "Привет ").text() == "Привет мир "


def test_children_split_their_parent():
    d = Doc()
    (base,) = d.edit(update([(ROOT, 0)], ["base"]))
    d.edit(update([(base, 2)], [" inserted "]))
    assert d.text() == "ba inserted se"
    d = Doc()
    (base,) = d.edit(update([(ROOT, 0)], ["abcde"]))
    d.edit(update([(base, 3), (base, 1)], ["[C1]", "[C2]"]))
    assert d.text() == "a[C2]bc[C1]de"
    assert "".join(s for _, _, s in segments(d.tree, d.texts)) == d.text()
    d.edit(update([(base, 99)], ["!"]))
    assert d.text() == "a[C2]bc[C1]de!"


def test_deletion_keeps_children_and_forks_apart():
    d = Doc()
    (p,) = d.edit(update([(ROOT, 0)], ["parent "]))
    d.edit(update([(p, 7)], ["child"]))
    d.edit(deletions(p))
    assert d.text() == "child"
    d = doc("hello")
    fork = apply_edit(d.texts, (2, 0, "a"), deletions(next(iter(d.texts))))
    assert d.text() == "hello" and render_text(d.tree, fork) == ""


def test_applying_an_edit_again_changes_nothing():
    d = Doc()
    d.edit(update([(ROOT, 0)], ["test"]), tx=1)
    d.edit(update([(ROOT, 0)], ["test"]), tx=1)
    assert d.text() == "test"
    assert apply_edit({}, (1, 0, "a"), update([(ROOT, 0)], [""])) == {}


def test_concurrent_edits_merge():
    d = doc("hello world")
    a, b = diff_text(d.tree, d.texts, "hello, world"), diff_text(d.tree, d.texts, "hello world!")
    left, right = apply_edit(d.texts, (2, 0, "x"), a), apply_edit(d.texts, (3, 0, "y"), b)
    d.tree.apply((2, 0, "x"), a)
    d.tree.apply((3, 0, "y"), b)
    assert render_text(d.tree, merge_texts(left, right)) == "hello, world!"
    assert merge_texts({(1, 0, 0, "a"): "l"}, {(1, 0, 0, "a"): "r"}) == {(1, 0, 0, "a"): "r"}


def test_update_constructors():
    with pytest.raises(ValueError):
        update([(ROOT, 0)], [])
    assert is_empty(update()) and size(update([(ROOT, 0)], ["x"], [(1, 0, 0, "a")])) == 2
    assert len(doc("a").tree) == 1 and ROOT in doc("a").tree


@pytest.mark.parametrize("old, new", [("", "x"), ("abc", "abcd"), ("abc", "zabc"), ("abc", "abXc"), ("abc", "bc"), ("abc", "ab"), ("abc", ""), ("abc", "xyz"), ("Привет", "Привет, мир"), ("日本語", "日語x"), ("", "")])
def test_diff_round_trips(old, new):
    tree, texts = single(old)
    upd = diff_text(tree, texts, new)
    tree.apply((1, 0, "b"), upd)
    assert render_text(tree, apply_edit(texts, (1, 0, "b"), upd)) == new


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc é", max_size=12), min_size=1, max_size=6))
def test_any_series_of_diffs_round_trips(steps):
    d = Doc()
    for target in steps:
        d.edit(diff_text(d.tree, d.texts, target))
        assert d.text() == target


def random_document(draw, size):
    """Several anchors under the root and inside each other, some deleted."""
    tree, texts, every = Tree(), {}, []
    for tx in range(1, size + 1):
        parent = draw.choice([ROOT, *every]) if every else ROOT
        anchor = (tx, 0, 0, draw.choice("ab"))
        tree.add(anchor, parent, draw.randrange(14))
        texts[anchor] = "".join(draw.choice("abcde ") for _ in range(draw.randrange(1, 12)))
        every.append(anchor)
    for a in draw.sample(every, size // 5):
        texts.pop(a)
    return tree, texts


def test_diff_spares_untouched_anchors():
    import random

    for seed in range(1000):
        draw = random.Random(seed)
        tree, texts = random_document(draw, draw.randrange(2, 9))
        parts = segments(tree, texts)
        now = "".join(s for _, _, s in parts)
        at = draw.randrange(len(now) + 1)
        cut = min(len(now), at + draw.choice((0, 0, 1, 3)))
        target = now[:at] + draw.choice(("", "XY", "Z Z")) + now[cut:]
        upd = diff_text(tree, texts, target)
        reach, touched = 0, set()
        for a, _, s in parts:
            if reach < cut and at < reach + len(s) and cut > at:
                touched.add(a)
            reach += len(s)
        # a shortest script may cut other characters that read the same, across one more edge of anchors
        assert len(upd["deletions"]) <= len(touched) + 1, seed
        if cut == at:
            assert not upd["deletions"]
        event = (1 << 40, 0, "z")
        tree.apply(event, upd)
        assert render_text(tree, apply_edit(texts, event, upd)) == target, seed


def test_long_edits_round_trip():
    import random
    import time

    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 9))) for _ in range(3000)]
    began = time.time()
    for old, new in ((words, words[500:900] + words[:400] + words[1500:]), (words, [w[::-1] for w in words]), (["la"] * 3000, ["la"] * 500 + ["lo"] * 2000)):
        tree, texts = single(" ".join(old))
        upd = diff_text(tree, texts, " ".join(new))
        tree.apply((1, 0, "b"), upd)
        assert render_text(tree, apply_edit(texts, (1, 0, "b"), upd)) == " ".join(new)
    assert time.time() - began < 60


def test_shortest_scripts_are_shortest_and_hopeless_ones_are_not_tried():
    import random

    from tidelog.operators.text import _shortest

    class Counting(list):
        reads = 0

        def __getitem__(self, k):
            Counting.reads += 1
            return super().__getitem__(k)

    assert _shortest(Counting("ab" * 1000), Counting("cd" * 1000), 400) is None
    assert Counting.reads < 100
    draw = random.Random(5)
    for _ in range(300):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(40))) for _ in "ab")
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        edits = len(a) + len(b) - 2 * longest[-1][-1]
        pairs = _shortest(a, b, edits)
        assert len(pairs) == longest[-1][-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        assert pairs == _shortest(a, b, 400) and (not edits or _shortest(a, b, edits - 1) is None)


def test_documents_are_whole_across_slices_and_branches(spark):
    from tidelog.operators.text import SLICE, render, render_segments

    rows = [(d, b, t) for d, n in ((1, 3 * SLICE), (2, 1), (None, 2), (3, SLICE)) for b in (None, "x") for t in range(n)]
    anchor = "named_struct('tx_id', tx, 'route_id', 0L, 'idx', 0, 'sender', 'a') as anchor"
    made = spark.createDataFrame(rows, "doc bigint, branch string, tx bigint").selectExpr("doc", "branch", anchor, "concat(coalesce(branch, '-'), tx, ' ') as text")
    kind = made.schema["anchor"].dataType.simpleString()
    tree = made.selectExpr("doc", "anchor", f"cast(null as {kind}) as parent", "0 as offset").distinct()
    want = {(d, b): "".join(f"{b or '-'}{t} " for k, c, t in reversed(rows) if (k, c) == (d, b)) for d, b, _ in rows}
    lone = tree.where("doc is null").selectExpr("99L as doc", "anchor", "parent", "offset")  # anchors without texts are no document
    assert {(r.doc, r.branch): r.text for r in render(tree.unionByName(lone), made).collect()} == want
    pieces = render_segments(tree, made).collect()
    assert len(pieces) == len(rows)
    assert {key: "".join(r.text for r in sorted((r for r in pieces if (r.doc, r.branch) == key), key=lambda r: r.position)) for key in want} == want


def test_a_diff_that_several_readers_share_is_computed_once(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["text_diff_multi_anchor"](spark, __spark_entry__.SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("FlatMapCoGroups") == 1  # the last rendering
