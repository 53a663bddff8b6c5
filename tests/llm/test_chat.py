import pytest

from ragloom.llm import chat as C


def render(template, **data):
    return C.compile_template(template)(data)[0]


def test_language():
    assert render("a{{ x }}b", x=3) == "a3b"
    assert render("{% for m in ms %}{{ loop.index }}{{ m.r|upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"r": "a"}, {"r": "b"}]) == "1A,2B"
    assert render("{% if x == 1 %}one{% elif x in [2, 3] %}few{% else %}many{% endif %}", x=3) == "few"
    assert render("{% set y = x ~ '!' %}{{ y if y != '' else 'no' }}", x="hi") == "hi!"
    assert render("a  {{- ' b ' | trim -}}  c {# note #}d") == "abc d"
    assert render("{{ x['k'][0] }}{{ x.none }}{{ 'q' not in x.k }}", x={"k": ["v"]}) == "vTrue"
    assert render("{{ 1 + 2 * 3 }} {{ -x }} {{ 7 % 4 }} {{ 'it\\'s' }}", x=2) == "7 -2 3 it's"
    assert render("{{ x | default('d') | replace('d', 'e') }}{{ [1, 2] | join('-') }}") == "e1-2"


def test_more_of_the_language():
    ms = [{"role": "system", "content": " be kind "}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo", "tool_calls": [{"name": "f", "args": {"é": 1}}]}]
    assert render("{% for m in ms[1:] %}{{ m.role }}{% endfor %}|{{ 'abcdef'[::2] }}{{ 'abc'[-2:] }}{{ ms[:0] | length }}", ms=ms) == "userassistant|acebc0"
    assert render("{{ x is defined }}{{ y is defined }}{{ x.k is defined }}{{ x.q is not defined }}{{ x.n is none }}{{ y is none }}{{ x is mapping and x.k is string }}", x={"k": "v", "n": None}) == "TrueFalseTrueTrueTrueFalseTrue"
    assert render("{{ {'a': 1, 'b': [2, 'ü']} | tojson }}{{ {} | tojson(indent=2) }}{{ x | tojson }}", x={"n": None, "t": True}) == '{"a": 1, "b": [2, "ü"]}{}{"n": null, "t": true}'
    assert render("{% set ns = namespace(found=false, n=0) %}{% for m in ms %}{% if m.role == 'user' %}{% set ns.found = true %}{% endif %}{% set ns.n = ns.n + 1 %}{% endfor %}{{ ns.found }}{{ ns.n }}", ms=ms) == "True3"
    assert render("{% for k, v in d.items() %}{{ k }}={{ v }};{% endfor %}{{ ' x '.strip() }}{{ 'a,b'.split(',')[1] }}{{ d.get('z', 9) }}{{ 'abc'.startswith('a') }}", d={"p": 1, "q": 2}) == "p=1;q=2;xb9True"
    assert render("{% macro tag(name, end='') %}<{{ end }}{{ name }}>{% endmacro %}{{ tag('b') }}{{ tag('b', end='/') }}") == "<b></b>"
    assert render("{% raw %}{{ x }}{% if %}{% endraw %}!{%- raw -%}  {% a %} {%- endraw %}") == "{{ x }}{% if %}!{% a %}"
    assert render("{% for i in range(5) if i % 2 %}{{ loop.revindex }}{{ i }}{% else %}none{% endfor %}{% for x in [] %}{% else %}none{% endfor %}") == "2113none"
    assert render("{{ ms | selectattr('role', 'equalto', 'user') | map(attribute='content') | join(',') }}{{ ms | rejectattr('tool_calls') | list | length }}{{ 7 // 2 }}{{ 7 / 2 }}{{ 1.5 + 1 }}{{ '' | default('d', true) }}", ms=ms) == "hi233.52.5d"


def test_a_round_keeps_nothing_for_the_next():
    assert render("{% for i in [1, 0] %}{% if i %}{% set x = 'Y' %}{% endif %}[{{ x }}]{% endfor %}{{ x }}") == "[Y][]"
    assert render("{% set x = 1 %}{% for i in [1] %}{% set x = 2 %}{% endfor %}{{ x }}") == "1"


def test_shapes_of_public_templates():
    ms = [{"role": "system", "content": "S"}, {"role": "user", "content": " q1 "}, {"role": "assistant", "content": "a1"}, {"role": "user", "content": "q2"}]
    first = """{% if messages[0]['role'] == 'system' %}{% set system_message = messages[0]['content'] %}{% set loop_messages = messages[1:] %}{% else %}{% set loop_messages = messages %}{% set system_message = false %}{% endif %}
{%- for message in loop_messages %}
    {%- if (message['role'] == 'user') != (loop.index0 % 2 == 0) %}{{ raise_exception('roles must alternate') }}{% endif %}
    {%- if loop.index0 == 0 and system_message is not false %}{% set content = '<<SYS>>' + system_message + '<</SYS>>' + message['content'] %}{% else %}{% set content = message['content'] %}{% endif %}
    {%- if message['role'] == 'user' %}{{ bos_token + '[INST] ' + content.strip() + ' [/INST]' }}{% elif message['role'] == 'assistant' %}{% generation %}{{ ' ' + content.strip() + ' ' + eos_token }}{% endgeneration %}{% endif %}
{%- endfor %}"""
    run = C.compile_template(first)
    text, spans = run({"messages": ms, "bos_token": "<s>", "eos_token": "</s>"})
    assert text == "<s>[INST] <<SYS>>S<</SYS>> q1 [/INST] a1 </s><s>[INST] q2 [/INST]" and [text[a:b] for a, b in spans] == [" a1 </s>"]
    with pytest.raises(C.TemplateError, match="alternate"):
        run({"messages": ms[2:], "bos_token": "", "eos_token": ""})
    second = """{%- if tools %}
    {{- '<|im_start|>system\\n# Tools\\n<tools>' }}
    {%- for tool in tools %}
        {{- "\\n" + (tool | tojson) }}
    {%- endfor %}
    {{- "\\n</tools><|im_end|>\\n" }}
{%- endif %}
{%- set ns = namespace(multi_step_tool=true, last_query_index=messages|length - 1) %}
{%- for message in messages[::-1] %}
    {%- set index = (messages|length - 1) - loop.index0 %}
    {%- if ns.multi_step_tool and message.role == "user" and message.content is string and not(message.content.startswith('<tool>') and message.content.endswith('</tool>')) %}
        {%- set ns.multi_step_tool = false %}
        {%- set ns.last_query_index = index %}
    {%- endif %}
{%- endfor %}
{%- for message in messages %}
    {{- '<|im_start|>' + message.role + '\\n' + message.content + '<|im_end|>' + '\\n' }}
{%- endfor %}
{%- if add_generation_prompt %}
    {{- '<|im_start|>assistant\\n' }}
    {%- if enable_thinking is defined and enable_thinking is false %}
        {{- '<think></think>' }}
    {%- endif %}
{%- endif %}{{ ns.last_query_index }}""".replace("\\\\", "\\")
    out = render(second, messages=ms[:2], tools=[{"name": "f", "on": True}], add_generation_prompt=True, enable_thinking=False)
    assert out == '<|im_start|>system\n# Tools\n<tools>\n{"name": "f", "on": true}\n</tools><|im_end|>\n<|im_start|>system\nS<|im_end|>\n<|im_start|>user\n q1 <|im_end|>\n<|im_start|>assistant\n<think></think>1'
    third = """{% set offset = 1 if messages[0]['role'] == 'system' else 0 %}
{% for message in messages %}
    {% if message['content'] is not none %}
<|{{ message['role'] }}|>
{{ message['content'] | trim }}{{ eos_token if not loop.last }}
    {% endif %}
{% endfor %}
{{ offset }}"""
    assert C.compile_template(third, trim=True)({"messages": [*ms[:2], {"role": "x", "content": None}, ms[3]], "eos_token": "E"})[0] == "<|system|>\nSE\n<|user|>\nq1E\n<|user|>\nq2\n1"


def test_generation_spans():
    text, spans = C.compile_template("ab{% generation %}cde{{ x }}{% endgeneration %}f")({"x": "Ü!"})
    assert text == "abcdeÜ!f" and [text[a:b] for a, b in spans] == ["cdeÜ!"]


def test_folding():
    assert C.fold(C.parse("a{{ 1 + 1 }}{% if 1 == 1 %}b{% else %}{{ x }}{% endif %}{{ 'c' | upper }}")) == (C.Emit(C.Const("a2bC")),)
    assert C.fold(C.parse("{{ 1 % 0 }}"))  # fails only where it is reached


@pytest.mark.parametrize("bad", ["{{ x", "{% if x %}", "{% for x %}{% endfor %}", "{{ x.__class__() }}", "{{ f(1) }}", "{{ x | nope }}", "{% import os %}", "{{ }}", "{{ 'a }}", "{{ x is nope }}", "{{ 'a'.format(x) }}", "{{ x | join(sep=1) }}", "{{ x[1:2:3:4] }}", "{% raw %}", "{% macro f( %}{% endmacro %}", "{{ {'a' 1} }}"])
def test_refused(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)


@pytest.mark.parametrize("bad", ["{{ range(10000000) }}", "{% macro f() %}{{ f() }}{% endmacro %}{{ f() }}", "{{ x.strip() }}", "{% set x.y = 1 %}", "{{ 'a'[::0] }}", "{{ namespace(1) }}", "{% set n = namespace(t='ab') %}{% for i in range(60) %}{% set n.t = n.t + n.t %}{% endfor %}", "{% for a, b in [1] %}{% endfor %}"])
def test_what_fails_when_it_is_reached(bad):
    with pytest.raises(C.TemplateError):
        render(bad, x=3)


def test_sandbox():
    assert render("{{ x.__class__ }}{{ x.real }}{{ s.__len__ }}", x=3, s="abc") == ""


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 1, "assistant", ""), (2, 0, "system", None), (None, 0, "user", "lost"), (3, None, None, None), (1, 1, "assistant", "yo")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, messages string, m int")
    out = {r.conv_id: r for r in C.rendered(table).collect()}
    assert set(out) == {1, 2, 3} and out[1].n_turns == 3
    assert out[1].prompt == "<|im_start|>user\nhi<|im_end|>\n" + "<|im_start|>assistant\nyo<|im_end|>\n" * 2
    assert [out[1].prompt[int(a) : int(b)] for a, b in (s.split("-") for s in out[1].generated.split(","))] == ["yo<|im_end|>"] * 2
    assert out[3].prompt == "<|im_start|>\n<|im_end|>\n" and out[3].generated == ""
    assert C.rendered(table.where("false")).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "word " * 200_000), (1, 0, "assistant", "tie")], "conv_id long, turn long, role string, text string")
    assert len(C.rendered(long).first().prompt) > 1_000_000 and C.rendered(long).first().prompt.startswith("<|im_start|>assistant")
