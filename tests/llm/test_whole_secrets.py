import pytest

from strataloom.llm import secrets as S

LONG = "aB3xYz9aB3xYz9"


@pytest.mark.parametrize("name", sorted({*S.PASSWORD_NAMES, *S.TOKEN_NAMES, *S.KEY_NAMES}))
def test_every_name_has_its_hint(name):
    for own in (f"my_{name.replace(' ', '_')}", f"MY_{name.replace(' ', '_').upper()}", "my" + name.title().replace(" ", "")):
        assert S.name_kind(own)
        text = f'{{"{own}": "{LONG}"}}'
        assert [text[f.start : f.end] for f in S.find(text)] == [LONG], own


@pytest.mark.parametrize(
    "text,expected",
    [
        ('{"db_pw": "pine-tree42"}', ["pine-tree42"]),
        ('psw = "pine-tree42"', ["pine-tree42"]),
        (f'github_pat = "{LONG}"', [LONG]),
        (f'"sig": "{LONG}"', [LONG]),
        ('password =\\\n    "pine-tree42"', ["pine-tree42"]),
        ('password = (  # of the box\n    "pine-tree42"\n)', ["pine-tree42"]),
        ('{"password":\n  "pine-tree42"}', ["pine-tree42"]),
        ('String password\n    = "pine-tree42";', ["pine-tree42"]),
        (f'WithAccessKey(\n\t"{LONG}",\n)', [LONG]),
        ('password = """pine-tree42"""', ["pine-tree42"]),
        ("password = '''\npine-tree42\n'''", ["pine-tree42"]),
        ('os.environ.get(\n    "DB_PASSWORD",\n    "pine-tree42",\n)', ["pine-tree42"]),
        ('<add key="Password"\n     value="pine-tree42"/>', ["pine-tree42"]),
        ("<password>\n  pine-tree42\n</password>", ["pine-tree42"]),
        ('login(password=\n    "pine-tree42")', ["pine-tree42"]),
        ('const a = "{\\"password\\": \\"pine-tree42\\"}"', ["pine-tree42"]),
        ("x = '{\\\\'db_pw\\\\': 1}'; y = \"{'token': \\\"" + LONG + '\\"}"', []),
        (f'run("export API_KEY=\\"{LONG}\\"")', [LONG]),
        ("smtp:\n  password: |\n    pine-tree42\n  port: 25", ["pine-tree42"]),
        ("password: >-\n  pine-tree42\n", ["pine-tree42"]),
        ("password: |\nport: 25", []),
        ('config["db"]["password"] = "pine-tree42"', ["pine-tree42"]),
        (f'apiKey: Optional[str] = SecretStr("{LONG}")', [LONG]),
        (f'key := []byte("{LONG}")', [LONG]),
        ('password /* of the box */ = "pine-tree42"', ["pine-tree42"]),
        ('# password = (\n#   "pine-tree42"\n# )', ["pine-tree42"]),
        ('password = "correct horse battery staple"', ["correct horse battery staple"]),
        ('passphrase: "violet7 Harbor rain9"', ["violet7 Harbor rain9"]),
        ("x = 'glpat-" + "a1B2" * 6 + "'", ["glpat-" + "a1B2" * 6]),
        ("npm_" + "a1B2" * 9, ["npm_" + "a1B2" * 9]),
        ("sk-proj-" + "a1B2" * 12, ["sk-proj-" + "a1B2" * 12]),
        ("ASIA" + "A1B2" * 4, ["ASIA" + "A1B2" * 4]),
        # nothing to find
        ('api_key = getpass("api_key: ")', []),
        ('smtp_pass = os.environ.get("SMTP_PASS")', []),
        ("const adminPwd = await vault.get('kv/lease/admin_pwd');", []),
        ('password = "Please enter your password"', []),
        ('password_error = "two words 12"\npassword = "is not long enough 8"', []),
        ('checkPassword("pine-tree42 or so")', []),
        ('class Password:\n    """Password."""', []),
        ('password:\n  "key-one": 1', []),
        ('token = get(\n    "x")', []),
        ('path = "pattern-0123456789ab"\ndesign = "signal-0123456789ab"', []),
    ],
)
def test_whole_text(text, expected):
    assert [text[f.start : f.end] for f in S.find(text)] == expected
    assert not any(x in S.redact(text) for x in expected)
