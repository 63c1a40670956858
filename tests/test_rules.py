"""Every rule of the catalogue on code that breaks it and on code that does not."""

import pytest

from codeloom import rules as R

FILLER = "\n" * 30  # keeps what stands elsewhere out of a rule's reach

# rule, extension, code that breaks it, code that does not
CASES = [
    ("DOCUMENTATION.MISSING_DOCSTRING", "py", "def f(a):\n    return a", 'def f(a):\n    """Gives a."""\n    return a'),
    ("DOCUMENTATION.MISSING_DOCSTRING", "js", "\nfunction f() {}", "/** Does. */\nfunction f() {}"),
    ("GIT.FORCE_PUSH", "sh", "git push origin main --force", "git push --force-with-lease"),
    ("GIT.FORCE_PUSH", "sh", "git push -f", "# git push -f"),
    ("GIT.HARD_RESET", "sh", "git reset HEAD~1 --hard", "git reset --soft HEAD~1"),
    ("GIT.DESTRUCTIVE_OPS", "sh", "git clean -xfd", "git clean -n"),
    ("RESILIENCE.MISSING_RETRY", "py", "r = requests.get(url, timeout=3)", "for attempt in range(3):\n    r = requests.get(url, timeout=3)"),
    ("RESILIENCE.MISSING_RETRY", "py", "r = requests.get(url, timeout=3)" + FILLER + "# retry the build", "@retry(3)\ndef f():\n    return requests.get(url)"),
    ("RESILIENCE.MISSING_TIMEOUT", "py", "r = requests.post(url)", "r = requests.post(\n    url,\n    timeout=5,\n)"),
    ("RESILIENCE.MISSING_TIMEOUT", "js", "const r = await fetch(url);", "const r = await fetch(url, { signal: AbortSignal.timeout(5000) });"),
    ("RESILIENCE.SWALLOWED_EXCEPTIONS", "py", "try:\n    f()\nexcept E:\n    pass", "try:\n    f()\nexcept E:\n    raise"),
    ("RESILIENCE.SWALLOWED_EXCEPTIONS", "js", "try { f() } catch (e) {}", "try { f() } catch (e) { throw e }"),
    ("RESILIENCE.UNSAFE_CONCURRENCY", "py", "t = threading.Thread(target=f)", "lock = threading.Lock()\nt = threading.Thread(target=f)"),
    ("RESILIENCE.UNSAFE_LOOP", "py", "while True:\n    f()", "while True:\n    if f():\n        break"),
    ("RESILIENCE.UNSAFE_LOOP", "py", "while True:\n    f()" + FILLER + "for x in y:\n    break", "while True:\n    yield f()"),
    ("RESILIENCE.UNSAFE_LOOP", "go", "for {\n\tf()\n}", "for {\n\treturn\n}"),
    ("RESILIENCE.UNSAFE_NULL", "js", "el = document.querySelector('a').value", "el = document.querySelector('a')"),
    ("RESILIENCE.UNSAFE_RESOURCE", "py", "f = open(p)", "with open(p) as f:\n    pass"),
    ("RESILIENCE.UNSAFE_RESOURCE", "py", "s = socket.socket()", "s = socket.socket()\ntry:\n    pass\nfinally:\n    s.close()"),
    ("RESILIENCE.UNSAFE_RESOURCE", "js", "const t = setInterval(f, 10);", "const t = setInterval(f, 10);\nclearInterval(t);"),
    ("RESILIENCE.UNSAFE_RESOURCE", "js", "w.addEventListener('a', f);", "w.addEventListener('a', f, { once: true });"),
    ("RESILIENCE.UNSAFE_RESOURCE", "ts", "s$.subscribe(f);", "const s = s$.subscribe(f);\ns.unsubscribe();"),
    ("RESILIENCE.UNSAFE_RESOURCE", "js", "const w = new WebSocket(u);", "const w = new WebSocket(u);\nw.close();"),
    ("SECURITY.COMMAND_INJECTION", "py", "os.system(cmd)", "subprocess.run([cmd])"),
    ("SECURITY.COMMAND_INJECTION", "py", "subprocess.run(f'ls {x}', check=True)", "# os.system(cmd)"),
    ("SECURITY.INSECURE_CRYPTO", "py", "h = hashlib.md5(x)", "h = hashlib.sha256(x)"),
    ("SECURITY.INSECURE_DESERIALIZE", "py", "x = yaml.load(f)", "x = yaml.load(f, Loader=SafeLoader)"),
    ("SECURITY.INSECURE_RANDOM", "js", "const t = Math.random();", "const t = crypto.randomUUID();"),
    ("SECURITY.MISSING_AUTH", "py", "@app.route('/a')\ndef f(): pass", "@app.route('/a')\n@login_required\ndef f(): pass"),
    ("SECURITY.MISSING_HTTPS", "py", "u = 'http://api.shop.com/x'", "u = 'http://localhost:80'"),
    ("SECURITY.MISSING_HTTPS", "js", "const u = 'http://cdn.shop.com';", "// see http://cdn.shop.com"),
    ("SECURITY.PATH_TRAVERSAL", "py", "f(open(request.args['p']))", "f(open(fixed))"),
    ("SECURITY.SENSITIVE_EXPOSURE", "py", "print('the password is', password)", "print('done')"),
    ("SECURITY.SQL_INJECTION", "py", "c.execute('select * from t where a = ' + x)", "c.execute('select * from t where a = ?', (x,))"),
    ("SECURITY.SQL_INJECTION", "py", "c.execute(f'select {x}')", "c.execute(q)"),
    ("SECURITY.XSS_VULNERABILITY", "js", "e.innerHTML = x;", "e.textContent = x;"),
    ("TECH_DEBT.COMMENTED_CODE", "py", "# def old(a):", "# the old way of it"),
    ("TECH_DEBT.DEBUG_STATEMENTS", "py", "    print(x)", "    # print(x)"),
    ("TECH_DEBT.BREAKPOINTS", "js", "  debugger;", "  const debuggers = 1;"),
    ("TECH_DEBT.DEPRECATED_APIS", "py", "t = datetime.utcnow()", "t = datetime.now(UTC)"),
    ("TECH_DEBT.MAGIC_NUMBERS", "py", "if a > 3600:", "if a > HOUR:"),
    ("TECH_DEBT.NAMING_CONVENTIONS", "py", "def doThis(a):", "def do_this(a):"),
    ("TECH_DEBT.NAMING_CONVENTIONS", "js", "function do_this(a) {}", "function doThis(a) {}"),
    ("TECH_DEBT.TODO_MARKERS", "py", "x = 1  # TODO later", "todo = 1"),
    ("TECH_DEBT.FIXME_MARKERS", "go", "// FIXME", "fixme := 1"),
    ("TECH_DEBT.TOKEN_DRIFT", "ts", "const c = '#ff00aa';", "const c = theme.red;"),
    ("IMPORTANT.NEW_USAGE", "css", "a { color: red !important }", "a { color: red }"),
    ("SUPPRESSION.NO_RATIONALE", "py", "import a  # noqa", "import a  # noqa: F401 -- for its side effects"),
]


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(2 * i + k, f"d/{2 * i + k}.{ext}", text) for i, (_, ext, bad, good) in enumerate(CASES) for k, text in enumerate((bad, good))]
    files = spark.createDataFrame(rows, "file_id bigint, file_path string, content string")
    found: dict = {}
    for r in R.scan(files).collect():
        found.setdefault(r["file_id"], set()).add(r["rule_id"])
    return found


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_rule(findings, i):
    rule = CASES[i][0]
    assert rule in findings.get(2 * i, set())
    assert rule not in findings.get(2 * i + 1, set())


def test_every_rule_has_a_case():
    assert {r.rule_id for r in R.RULES} == {c[0] for c in CASES}


def test_confidence_and_changed_lines(spark):
    files = spark.createDataFrame([(1, "a.py", "breakpoint()\nif a > 3600:\n    breakpoint()")] * 2, "file_id bigint, file_path string, content string")
    at = lambda **how: {(r["line_no"], r["rule_id"]) for r in R.scan(files, **how).collect()}
    assert at() == {(1, "TECH_DEBT.BREAKPOINTS"), (2, "TECH_DEBT.MAGIC_NUMBERS"), (3, "TECH_DEBT.BREAKPOINTS")}
    assert at(least_confidence=0.6) == {(1, "TECH_DEBT.BREAKPOINTS"), (3, "TECH_DEBT.BREAKPOINTS")}
    changed = spark.createDataFrame([("a.py", 2, 3), ("a.py", 3, 3), ("b.py", 1, 9)], "file_path string, start int, end int")
    assert at(ranges=changed) == {(2, "TECH_DEBT.MAGIC_NUMBERS"), (3, "TECH_DEBT.BREAKPOINTS")}
    assert at(rule_ids=["NONE"]) == set() and R.scan(files).count() == 3
