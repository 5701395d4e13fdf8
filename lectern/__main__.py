"""python -m lectern COMMAND PROJECT: the stages of a project. analyze, translate and pronounce need the model service that the
project names (its key is in MODEL_API_KEY)."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None, provider=None) -> int:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("command", choices=["version", "import", "analyze-chapters", "analyze", "translate", "verify-glossary", "pronounce", "ssml", "tts", "status", "chapters"])
    p.add_argument("project", nargs="?", default=".")
    p.add_argument("--source")
    p.add_argument("--force", action="store_true")
    p.add_argument("--chapter", type=int, default=0)
    p.add_argument("--range", default="", dest="span")
    p.add_argument("--strategy")
    p.add_argument("--strip", action="append", default=[])
    p.add_argument("--start-id", type=int)
    p.add_argument("--poll-interval", type=int, default=60)
    p.add_argument("--continue", action="store_true", dest="go_on")
    p.add_argument("--skip-memory", action="store_true")
    p.add_argument("--reset", action="store_true")
    p.add_argument("--use-stress-json", action="store_true", help="marks from the project's vocabulary rather than the speech server's model")
    p.add_argument("--on-problem", choices=["fail", "transliterate"], default="fail")
    a = p.parse_args(argv)
    if a.command == "version":
        print("0.1")
        return 0
    from pyspark.sql import SparkSession

    from .operators import overview
    from .plans.commands import Project
    from .streaming import clients

    project = Project(SparkSession.builder.getOrCreate(), a.project, provider)
    if a.command in ("analyze", "translate", "pronounce"):
        if provider is None:
            project.provider = clients.ModelService(project.config.model.base_url, retries=project.config.model.max_retries)
        more = {"analyze": {}, "translate": {"skip_memory": a.skip_memory}, "pronounce": {"reset": a.reset}}[a.command]
        try:
            print(getattr(project, a.command)(a.chapter, a.span, a.force, a.go_on, every=a.poll_interval, **more))
        except (LookupError, RuntimeError) as e:
            print(e, file=sys.stderr)
            return 1
    elif a.command == "import":
        project.import_book(a.source, a.force)
    elif a.command == "analyze-chapters":
        project.analyze_chapters(a.chapter, a.span, a.strategy, tuple(a.strip), a.start_id, a.force).show(truncate=False)
    elif a.command == "verify-glossary":
        project.verify_glossary().show(truncate=False)
    elif a.command == "ssml":
        server = project.config.tts.server_url
        model = clients.StressClient(server) if server and not a.use_stress_json else None
        print(project.ssml(a.chapter, a.span, a.force, a.on_problem, model))
    elif a.command == "tts":
        project.tts(a.chapter, a.span, a.force)
    elif a.command == "status":
        project.status().groupBy("status").count().show()
    else:
        for row in overview.table_lines(project.overview()).orderBy("id").toLocalIterator():
            print(row["line"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
