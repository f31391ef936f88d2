"""Front-end calls and configuration of texts that a template doesn't yield."""

import pytest

from lakeaudit.operators import config, front
from lakeaudit.operators.java import Source
from lakeaudit.sources.files import files_from_table


def files(spark, **texts):
    rows = [("p", "src/" + name.replace("__", "."), text, len(text or "")) for name, text in texts.items()]
    return files_from_table(spark.createDataFrame(rows, "project_id string, relative_path string, content string, byte_size long"))


@pytest.mark.parametrize(
    "expression, url",
    [
        ("'/a'", ("/a", False)), ('"/a\\/b"', ("/a/b", False)), ("`/a/${id}/b`", ("/a/{}/b", True)), ("`/a`", ("/a", False)), ("'/a/' + id + '/b'", ("/a/{}/b", True)),
        ("'/a' + '/b'", ("/a/b", False)), ("base", ("", True)), ("", ("", True)), ("f('x' + y)", ("", True)), ("f(a + b) + '/c'", ("{}/c", True)), ("'a+b'", ("a+b", False)), ("'/a' +", ("", True)),
    ],
)
def test_folding(expression, url):
    assert front.folded(expression) == url


def test_calls():
    def calls(text):
        return [(c["line"], c["method"], c["url"], c["function"]) for c in front.calls_of(Source(text))]

    assert calls("") == [] and calls("axios.get(") == [] and calls("request({ url: '/a'") == []
    assert calls("axios.get('/a'); axios.get('/a');\naxios.get('/a')") == [(1, "GET", "/a", ""), (2, "GET", "/a", "")]
    assert calls("/* fetch('/a') */ prefetch('/b'); fetch('/c', { method: 'x' })") == [(1, "FETCH", "/c", "")]
    assert calls("request({ method: 'post', url: '/a/' + id, data: d })") == [(1, "POST", "/a/{}", "")] and calls("request({ url: '/a' })") == [(1, "REQUEST", "/a", "")]
    far = "function f() { return 1 }\n" + " " * front.REACH
    assert calls(far + "axios.get('/a')") == [(2, "GET", "/a", "")]
    assert calls("function f() {}\nconst g = async (x) => axios.get('/a')\nfunction h() {}") == [(2, "GET", "/a", "g")]


def test_last_wrapper_wins(spark):
    scanned = front.front_facts(files(spark, a__ts="function get() { return axios.get('/a') }", b__js="function get() { return axios.get('/b') }", V__vue="function go() { get(1); other() }\nfunction no() { x.y }", n__ts="", W__vue="function cut() { get("))
    edges = front.link_actions_to_calls(front.extract_frontend_functions(scanned), front.extract_http_calls(scanned)).collect()
    assert [(e.source, e.target) for e in edges] == [("action:src/V.vue:1:go", "api:src/b.js:1:GET/b")]


def test_flatten():
    def flat(text):
        return [(r["key"], r["value"], r["line"]) for r in config.flat(text)]

    assert flat("") == [] and flat("# a: b\n\nplain\n") == []
    assert flat("a:\n  b: 'x:y'\n  c:\n    d: 1\ne: \"2\"\n") == [("a", "", 1), ("a.b", "x:y", 2), ("a.c", "", 3), ("a.c.d", "1", 4), ("e", "2", 5)]
    assert flat("a:\r\n b:\r\n b: 1") == [("a", "", 1), ("a.b", "", 2), ("a.b", "1", 3)]


def test_relevant(spark):
    text = "spring:\n  profiles: dev\n  datasource:\n    password:\n    token: t\nserver: 1\nnacos.url: x\n"
    keys = config.flatten_yaml(files(spark, **{"application-x_1__yml": text, "b__yaml": "mybatis: NACOS:a"}))
    got = {(r.key, r.value, r.sensitive, r.remote_reference, r.profile) for r in config.relevant_config(keys).collect()}
    assert got == {
        ("spring.profiles", "dev", False, False, "x_1"), ("spring.datasource", "", False, False, "x_1"), ("spring.datasource.password", "", True, False, "x_1"),
        ("spring.datasource.token", "[已脱敏]", True, False, "x_1"), ("nacos.url", "x", False, True, "x_1"), ("mybatis", "NACOS:a", False, True, ""),
    }
