"""Git repositories as a data source, in batches and as a stream."""

import subprocess

import pytest
from pyspark.sql import functions as F

from gleaner.operators import matcher
from gleaner.sources import blobs, git, git_source
from gleaner.sources.rules import Rule


def _git(repo, *args):
    env = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(repo)}
    return subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=env).stdout.decode().strip()


def _commit(repo, name, text):
    (repo / name).write_text(text)
    _git(repo, "add", "-A")
    _git(repo, "commit", "-qm", name)


@pytest.fixture
def repo(tmp_path):
    where = tmp_path / "repo"
    where.mkdir()
    _git(where, "init", "-q", "-b", "main")
    for i in range(6):
        _commit(where, f"f{i % 4}.txt", f"text {i % 5}")
    _git(where, "checkout", "-qb", "side", "HEAD~3")
    _commit(where, "side.txt", "key=a1b2c3")
    _git(where, "checkout", "-q", "main")
    _git(where, "merge", "-q", "side", "-m", "merge")
    return where


@pytest.mark.parametrize("rows", [1, 3, 5000])
def test_tables_are_those_of_the_readers(spark, repo, rows):
    git_source.register(spark)
    read = lambda table: spark.read.format("gleaner_git").option("path", str(repo)).option("table", table).option("rows", rows).load()
    commits, changes = git.read_history(spark, str(repo))
    told = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert told(read("changes")) == told(changes)
    mine = read("commits")
    assert told(mine.drop("topo")) == told(commits.drop("topo"))
    # numbers may differ where commits are not ordered, but ancestors have smaller ones
    links = mine.select(F.col("topo").alias("n"), F.explode("parents").alias("p")).join(mine.select(F.col("commit_id").alias("p"), "topo"), "p")
    assert links.where("topo >= n").count() == 0 and mine.select("topo").distinct().count() == 8
    assert told(read("objects")) == told(git.read_objects(spark, str(repo)))
    assert read("changes").rdd.getNumPartitions() == -(-8 // rows)
    assert told(git.first_seen(mine, read("changes"))) == told(git.first_seen(commits, changes))


def test_other_tables_are_refused(spark, repo):
    git_source.register(spark)
    with pytest.raises(Exception, match="nothing|KeyError"):
        spark.read.format("gleaner_git").option("path", str(repo)).option("table", "nothing").load().count()


def test_a_stream_reads_new_commits_only(spark, repo, tmp_path):
    git_source.register_stream(spark)
    rule = Rule("demo.key", "Key", r"key=([a-z0-9]{6})")

    def run():
        rows = spark.readStream.format("gleaner_git_stream").option("path", str(repo)).option("rows", 2).load()
        origin = F.array(blobs.origin("git_repo", F.col("path")))
        found = matcher.scan(rows.select("commit_id", "path", "blob_id", "content", origin.alias("origins")), [rule])
        flat = found.select("commit_id", "path", "secret")
        query = flat.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        query.awaitTermination()
        return query.lastProgress["numInputRows"] if query.lastProgress else 0, sorted(r["secret"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first, secrets = run()
    assert first >= 8 and set(secrets) == {"a1b2c3"}
    before = len(secrets)
    _commit(repo, "new.txt", "key=d4e5f6")
    _git(repo, "checkout", "-qb", "late", "HEAD~1")
    _commit(repo, "late.txt", "key=g7h8i9")
    second, secrets = run()
    assert second == 2 and secrets[before:] == ["d4e5f6", "g7h8i9"]
