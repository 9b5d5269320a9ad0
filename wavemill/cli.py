"""Command line: conformance cases, vectors and certificates.

    python -m wavemill.cli list [PREFIX ...]
    python -m wavemill.cli hashes
    python -m wavemill.cli selftest [--full] [--backend NAME]
    python -m wavemill.cli run [PREFIX ...]
    python -m wavemill.cli generate PATH [PREFIX ...]
    python -m wavemill.cli check PATH [PREFIX ...]
    python -m wavemill.cli issue MANIFEST.json
    python -m wavemill.cli verify CERTIFICATE.json INPUTS
    python -m wavemill.cli serve SESSION

Exit codes: 0 all passed, 1 something differs or fails, 2 wrong use. `run`, `generate`,
`check` and `serve` start Spark; paths are read by Spark there.
"""

from __future__ import annotations

import argparse
import json
import sys

from .functions import provenance, sweeps
from .plans import certificate, conformance


def _spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavemill", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "run"):
        sub.add_parser(name).add_argument("prefix", nargs="*")
    sub.add_parser("hashes")
    t = sub.add_parser("selftest")
    t.add_argument("--full", action="store_true")
    t.add_argument("--backend", default="cpu")
    for name in ("generate", "check"):
        t = sub.add_parser(name)
        t.add_argument("path")
        t.add_argument("prefix", nargs="*")
    sub.add_parser("issue").add_argument("manifest")
    t = sub.add_parser("verify")
    t.add_argument("certificate")
    t.add_argument("inputs")
    sub.add_parser("serve").add_argument("session")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        a = _arguments().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    prefixes = tuple(getattr(a, "prefix", None) or ("",))
    if a.command == "list":
        print(*[c for c in conformance.cases() if c.startswith(prefixes)], sep="\n")
        return 0
    if a.command == "hashes":
        print(provenance.canonical({"digests": conformance.DIGESTS, "sweeps": sweeps.HASHES}))
        return 0
    if a.command == "selftest":
        got = conformance.selftest(a.backend, "full" if a.full else "quick")
        print(provenance.canonical(got))
        return int(got["failed"] > 0)
    if a.command == "issue":
        with open(a.manifest, encoding="utf-8") as f:
            print(certificate.issue(f.read()))
        return 0
    if a.command == "verify":
        with open(a.certificate, encoding="utf-8") as f:
            got = certificate.verify(f.read(), a.inputs)
        print(provenance.canonical({"error": got.error, "manifest_hash_ok": got.manifest_hash_ok, "outputs": [[n, ok] for n, ok in got.outputs], "verified": got.verified}))
        return int(not got.verified)
    spark = spark or _spark()
    if a.command == "run":
        text = conformance.report(conformance.check(spark, prefixes=prefixes))
        print(text, end="")
        return int(bool(json.loads(text)["failures"]))
    if a.command == "generate":
        conformance.generate(spark, a.path, prefixes)
        return 0
    if a.command == "check":
        bad = conformance.run_against(spark, a.path, prefixes=prefixes).where("not passed").orderBy("case", "output").collect()
        for r in bad:
            print(f"{r.case} {r.output}: element {r.at}, {r.ulps} units in the last place")
        return int(bool(bad))
    from .sources.server import serve
    from .sources.session import Session

    serve(Session(spark, a.session), sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
