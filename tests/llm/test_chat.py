"""Templates, escaping, and what formatted text says when it is read back."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderloom.llm import chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "|turn|>", "/s>", "a", "é", "\n", "INST]"])).map("".join))
def test_escaping_is_reversible_and_hides_controls(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


def render(template, messages):
    pieces = list(chat.compile_template(template)(messages))
    return "".join(p for p, _ in pieces), [p[a:b] for p, spans in pieces for a, b in spans]


def test_template_language():
    t = (
        "{{ 'a' ~ 1 + 2 }}{% if true and not false %}yes{% else %}no{% endif %}"
        "{% for message in messages %}{{ loop.index }}{% if loop.first %}F{% elif loop.last %}L{% else %}M{% endif %}"
        "{% generation %}{{ message.text | trim | upper }}{% endgeneration %}"
        "{% if 'x' in message.role or message.role != \"q\" %}!{% endif %}{% endfor %}{{ '\\n' }}"
    )
    assert render(t, [("q", " a "), ("x", "b"), ("q", "")]) == ("a12yes1FA2MB!3L\n", ["A", "B"])
    assert render(t, []) == ("a12yes\n", [])


def test_constants_are_folded():
    nodes = chat.fold_all(chat.parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}d{% endif %}{{ 2 + 3 }}"))
    assert nodes == (("text", "aBc5"),)


@pytest.mark.parametrize(
    "bad",
    ["{{ x }}", "{{ message.__class__ }}", "{{ 1 | eval }}", "{% if 1 %}", "{% while 1 %}", "{{ (1 }}", "{{ 1 2 }}", "{{ '' }}{% endfor %}", "{{ message['a'] }}"],
)
def test_nothing_else_is_reachable(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def brute(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in groups.items():
        turns.sort()
        all_, loss = hashlib.sha256(), "".join(t for *_, r, t in turns if r == "assistant")
        for *_, r, t in turns:
            all_.update(f"{r}\n{t}\n".encode())
        out.add((conv, len(turns), all_.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_round_trip(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>", "\\<s>", "<\\\\s>", "é\U0001f600\n", "x" * 300_000, "\r\n\x00"]
    rows = [(i % 7, i // 7, ["user", "assistant", "system", None, "<|text|>", "user"][i % 6], odd[i % len(odd)]) for i in range(120)]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (9, 0, "user", "t"), (9, 0, "assistant", "s")]
    rows += [(9, 0, "user", "t")] + [(50, i, "assistant", f"m{i}") for i in range(5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(0))
    pieces = chat.format_chats(turns.repartition(4))
    got = chat.read_back(pieces).collect()
    assert {tuple(r)[:5] for r in got} == brute(rows) and len(got) == len(brute(rows))
    chars = {r.conv_id: r.n for r in pieces.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert {r.conv_id: r.formatted_chars for r in got} == chars
    again = chat.read_back(chat.in_order(pieces.repartition(3))).collect()
    assert set(again) == set(got)
    assert chat.read_back(chat.format_chats(turns.limit(0))).collect() == []
