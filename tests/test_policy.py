import json

import pytest
from pyspark.sql import functions as F

from shelltrail.functions.policy import EnvPolicy, hash_value
from shelltrail.operators import policy as operators

VERDICTS = {
    "plain": "PWD USER CI LC_ALL DOCKER_HOST NODE_ENV TEST_ENV DB_HOST PYTHON_VERSION GIT_BRANCH K8S_NAMESPACE TERRAFORM_VERSION",
    "hash": "API_KEY TEST_API_KEY KUBE_TOKEN SESSION_PROFILE SSL_CERT_PATH GIT_AUTHOR_NAME MONKEY_HOME DATABASE_URL JENKINS_URL",
    "not_allowed": "SECRET_TOKEN API_PASSWORD OAUTH_CLIENT_SECRET SAFE_VAR TEST_ENV_VAR TEST_NOISE_VAR TERM_PROGRAM "
    "E2E_TEST_KEY E2E_TEST_ENV A1_VERSION py_VERSION",
    "deny": "TERM HISTFILE OPTIND BASH_VERSION __X_ENV OPTIMIZER_HOME",
}
EXPECTED = {name: verdict for verdict, names in VERDICTS.items() for name in names.split()}


def verdicts(spark, policy):
    frame = spark.createDataFrame([(name,) for name in EXPECTED], "key string")
    return {row["key"]: row["v"] for row in frame.select("key", policy.verdict(F.col("key")).alias("v")).collect()}


def test_verdicts(spark):
    assert verdicts(spark, EnvPolicy()) == EXPECTED


def test_urls_stay_plain_without_the_flag(spark):
    lax = verdicts(spark, EnvPolicy(hash_sensitive_values=False))
    assert lax == {**EXPECTED, "DATABASE_URL": "plain", "JENKINS_URL": "plain"}


def test_own_names_are_denied_anywhere_in_a_name(spark):
    policy = EnvPolicy(own_names=("MYTOOLROOT",))
    frame = spark.createDataFrame([("XMYTOOLROOT_HOME",)], "key string")
    assert frame.select(policy.verdict(F.col("key"))).first()[0] == "deny"
    assert frame.select(EnvPolicy().verdict(F.col("key"))).first()[0] == "plain"


def test_masking_agrees_with_the_verdicts(spark, make_events):
    env = {name: f"value of {name}" for name in EXPECTED}
    rows = operators.mask_environment(make_events([{"env": env}]), EnvPolicy()).first()["env"]
    assert set(rows) == {name for name, verdict in EXPECTED.items() if verdict in ("plain", "hash")}
    for name, value in rows.items():
        assert (value == env[name]) == (EXPECTED[name] == "plain")


def test_empty_results_are_null(make_events):
    events = make_events([{"env": {"TERM": "xterm"}}, {"env": {}}, {"env": None}, {"env": {"CI": ""}}])
    masked = operators.mask_environment(events, EnvPolicy()).orderBy("event_id").collect()
    assert [row["env"] for row in masked] == [None, None, None, {"CI": ""}]


@pytest.mark.parametrize(
    "value, expected", [("secret123", "h8_fcf730b6"), ("secret5", "h8_19aa8a9a"), ("", "h8_e3b0c442")]
)
def test_hash(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(hash_value(F.col("v"))).first()[0] == expected


def test_simple_policy_drops_nothing(make_events):
    events = make_events([{"env": {"MyKey": "a", "TERM": "xterm", "x": "y"}}])
    masked = operators.mask_simple(events).first()["env"]
    assert masked["TERM"] == "xterm" and masked["x"] == "y" and masked["MyKey"].startswith("h8_")


def test_hashed_values_are_not_hashed_again(spark):
    frame = spark.createDataFrame([("h8_fcf730b6",), ("plain",)], "v string")
    again = [row[0] for row in frame.select(EnvPolicy().masked_value(F.lit("API_KEY"), F.col("v"), True)).collect()]
    assert again[0] == "h8_fcf730b6" and again[1] != "plain"


def test_configuration(spark, tmp_path):
    path = tmp_path / "policy.json"
    path.write_text(json.dumps({"version": "7", "allowlist": {"exact": ["A"]}, "denylist": {"patterns": ["^A$"]}}))
    policy = EnvPolicy.load(str(path))
    assert policy.version == "7" and not policy.hash_sensitive_values and policy.deny_names == ()
    assert EnvPolicy.from_json(policy.to_json()) == policy
    (tmp_path / "bad.json").write_text("invalid json")
    with pytest.raises(ValueError):
        EnvPolicy.load(str(tmp_path / "bad.json"))
    with pytest.raises(OSError):
        EnvPolicy.load(str(tmp_path / "missing.json"))
    assert EnvPolicy.load(search=[str(tmp_path / "bad.json"), str(path)]) == policy
    assert EnvPolicy.load(search=[str(tmp_path / "missing.json")]) == EnvPolicy()


def test_bad_pattern_is_named(spark):
    with pytest.raises(ValueError, match=r"\[A"):
        EnvPolicy(allow_patterns=("[A",)).check(spark)
    assert EnvPolicy().check(spark)


def test_audit_and_leaks(make_events):
    events = make_events([{"env": {"CI": "1", "API_KEY": "x", "FOO": "y"}}, {"env": {"API_KEY": "h8_00000000"}}])
    audit = {row["key"]: row for row in operators.policy_audit(events, EnvPolicy()).collect()}
    assert audit[None]["n_variables"] == 3 and audit[None]["n_captured"] == 2 and audit[None]["n_events"] == 4
    assert audit["FOO"]["verdict"] == "not_allowed" and audit["API_KEY"]["n_events"] == 2
    assert [tuple(row) for row in operators.leak_check(events, EnvPolicy()).collect()] == [("API_KEY", 1)]
