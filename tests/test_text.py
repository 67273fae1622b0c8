import pytest
from pyspark.sql import functions as F

from shelltrail.functions import text, times, values


def one(spark, column, **inputs):
    names = list(inputs)
    frame = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{name} string" for name in names))
    return frame.select(column).first()[0]


@pytest.mark.parametrize(
    "command, expected",
    [
        ("""git commit -m 'a b' "c d" x""", ["git", "commit", "-m", "'a b'", '"c d"', "x"]),
        ("  ls   -la ", ["ls", "-la"]),
        ('cd "~/x y"', ["cd", '"~/x y"']),
        ("echo 'open end ", ["echo", "'open end"]),
        ("""a"b c"d 'e"f' g""", ['a"b c"d', """'e"f'""", "g"]),
        ("", []),
        ("   ", []),
        ("a\u00a0b\u3000c\x1cd", ["a", "b", "c", "d"]),
        ("échô 'ü ö'\n-x", ["échô", "'ü ö'", "-x"]),
    ],
)
def test_shell_words(spark, command, expected):
    assert one(spark, text.shell_words(F.col("c")), c=command) == expected
    assert one(spark, text.command_name(F.col("c")), c=command) == (expected[0] if expected else "")


def test_shell_words_of_any_length(spark):
    glued = '"x"' * 100_000
    assert one(spark, F.size(text.shell_words(F.col("c"))), c=glued) == 1
    assert one(spark, F.size(text.shell_words(F.col("c"))), c="a " * 50_000) == 50_000


def python_words(command):
    """The tokenizer written as a loop over characters."""
    found, word, quote = [], "", None
    for char in command.strip():
        if char in "\"'":
            quote = char if quote is None else None if quote == char else quote
            word += char
        elif char.isspace() and quote is None:
            found, word = found + [word] if word else found, ""
        else:
            word += char
    return found + [word] if word else found


def test_shell_words_like_a_loop_over_characters(spark):
    import random

    chance = random.Random(5)
    texts = ["".join(chance.choice("ab\"' \t\u2003é\\") for _ in range(chance.randint(0, 40))) for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "c string")
    for row in frame.select("c", text.shell_words(F.col("c")).alias("w")).collect():
        assert row["w"] == python_words(row["c"]), row["c"]


def python_ngrams(line):
    grams = []
    for word in line.lower().split():
        padded = f" {word} "
        for n in range(2, 6):
            grams += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return sorted(grams)


@pytest.mark.parametrize("line", ["a", "ls -LA", "git commit -m x", "   ", "überlang wörter"])
def test_char_ngrams(spark, line):
    assert sorted(one(spark, text.char_ngrams(F.col("c")), c=line)) == python_ngrams(line)


def test_search_terms(spark):
    found = one(spark, text.search_terms(F.col("c")), c="Git-commit --ALL über_x 1.0")
    assert found == ["git", "commit", "all", "über_x", "1", "0"]


def test_display(spark):
    assert one(spark, text.shorten(F.col("c"), 50, 47), c="x" * 60) == "x" * 47 + "..."
    assert one(spark, text.shorten(F.col("c"), 50, 47), c="x" * 50) == "x" * 50
    assert one(spark, text.shorten_path(F.col("c")), c="/home/somebody/src/api") == ".../src/api"
    assert one(spark, text.shorten_path(F.col("c")), c="/home/u/src") == "/home/u/src"
    assert one(spark, text.path_label(F.col("c")), c="/home/u/") == "/ (/home/u/)"
    assert one(spark, text.path_label(F.col("c")), c="src") == "src"


@pytest.mark.parametrize(
    "since, expected",
    [
        ("2024-01-30 23:30:00", "30 min ago"),
        ("2024-01-30 21:00:00", "3 hours ago"),
        ("2024-01-29 20:00:00", "1 day ago"),
        ("2024-01-01 00:00:00", "30 days ago"),
    ],
)
def test_time_ago(spark, since, expected):
    assert one(spark, times.time_ago(F.col("c").cast("timestamp"), "2024-01-31 00:00:00"), c=since) == expected


@pytest.mark.parametrize(
    "value, basic, extended",
    [
        ("h8_fcf730b6", "hashed", "hashed"),
        ("h8_short", "hashed", "default"),
        ("/usr/bin", "path", "path"),
        ("/with blank", "path", "default"),
        ("C:\\x", "string", "path"),
        ("https://a/b", "url", "url"),
        ("1.2.3", "string", "version"),
        ("yes", "string", "boolean"),
        ("1", "string", "boolean"),
        ("42", "string", "number"),
        ("", "string", "default"),
    ],
)
def test_value_classes(spark, value, basic, extended):
    assert one(spark, values.value_class(F.col("c"), "basic"), c=value) == basic
    assert one(spark, values.value_class(F.col("c"), "extended"), c=value) == extended
