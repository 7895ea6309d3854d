"""Documentation in comments of any length."""

from quarry.functions import parse


def test_a_documentation_comment_longer_than_any_window():
    words = "\n".join(f" * word {i}" for i in range(900))
    made = parse.script_chunks(f"const a = '/** not this */';\n/**\n{words}\n */\nexport function f(a) {{\n  return a;\n}}\n\nfunction g() {{\n  return 1;\n}}\n", False)
    docs = {c[3]: c[8] for c in made}
    assert docs["f"].startswith("word 0\n") and docs["f"].endswith("word 899") and docs["g"] == ""
