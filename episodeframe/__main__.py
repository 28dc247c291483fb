"""Command line: ``python -m episodeframe report|summary|taxonomy|metric|compare|sim|engine|train ...``; 0 when done or asked for help, else 1."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

#: columns of a plan document that ``train`` reads
PLAN = "task string, q_star double, predicted_gain double, training_pairs array<struct<contrast_score:double,contrast_path:string,reinforce_path:string,reinforce_score:double,pair_gap:double>>"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="episodeframe")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, about in (("report", "leaderboard as text, summary as JSON"), ("summary", "summary as JSON"), ("taxonomy", "agents by consistency"), ("metric", "statistics of a list of rewards"), ("compare", "two models"), ("sim", "training simulation by strategy")):
        p = sub.add_parser(name, help=about)
        p.add_argument("path")
        p.add_argument("--output", "-o")
        p.add_argument("--completed-only", action="store_true")
        p.add_argument("--alpha", type=float, default=0.1)
        if name == "compare":
            p.add_argument("a")
            p.add_argument("b")
        if name == "sim":
            p.add_argument("--replicates", type=int, default=5000)
            p.add_argument("--rounds", type=int, default=1000)
            p.add_argument("--seed", type=int, default=42)
    p = sub.add_parser("engine", help="training plan of job folders")
    p.add_argument("job_dirs", nargs="+")
    p.add_argument("--agent", default="agent")
    p.add_argument("--model", default="unknown")
    p.add_argument("--tasks-dir")
    p.add_argument("--output", "-o", default="improvement_plan.json")
    p.add_argument("--cycle", type=int, default=1)
    p.add_argument("--enable-recursion", action="store_true")
    p.add_argument("--max-depth", type=int, default=3)
    p = sub.add_parser("train", help="trainer over a plan document")
    p.add_argument("--curriculum", required=True)
    p.add_argument("--trainer", choices=("noop", "simulated", "trl", "axolotl"), default="noop")
    p.add_argument("--output", "-o", default="train_output")
    p.add_argument("--model", default="model")
    return parser


def _engine(spark: SparkSession, args: argparse.Namespace) -> str:
    from episodeframe.plans import cycle
    from episodeframe.plans.recursion import RecursionConfig
    from episodeframe.sources import checkpoints, jobs

    eps = jobs.read_jobs(spark, args.job_dirs, tasks_dir=args.tasks_dir)
    if eps.isEmpty():
        raise ValueError("no trials in " + ", ".join(args.job_dirs))
    # Episodes carry their strata as a map; profiles look for the difficulty by name.
    eps = eps.withColumn("s_difficulty", eps["strata"]["difficulty"])
    steps = checkpoints.read_checkpoints(spark, args.tasks_dir) if args.enable_recursion and args.tasks_dir else None
    config = RecursionConfig(max_depth=args.max_depth) if args.enable_recursion else None
    made = cycle.run_cycle(eps, jobs.read_trajectory_dirs(spark, args.job_dirs), args.cycle, args.agent, args.model, recursive=config, checkpoints=steps)
    with open(args.output, "w", encoding="utf-8") as f:
        json.dump(cycle.document(made), f, indent=2)
    return cycle.plan_text(made)


def _train(spark: SparkSession, args: argparse.Namespace) -> str:
    from episodeframe.plans.trainers import trainer

    with open(args.curriculum, encoding="utf-8") as f:
        items = json.load(f)["curriculum"]
    plan = spark.createDataFrame([(json.dumps(i),) for i in items], "value string").selectExpr(f"from_json(value, '{PLAN}') as v").select("v.*")
    scores = trainer(args.trainer, args.model).train(plan, args.output)
    return "\n".join(f"{r['task']}: {r['score']:.3f}" for r in scores.orderBy("task").collect())


def _tables(spark: SparkSession, args: argparse.Namespace) -> str:
    from episodeframe.operators import metrics, taxonomy
    from episodeframe.plans import report, simulation
    from episodeframe.sources import generic

    lead = ""
    if args.command == "metric":
        out = metrics.reduce_scores(generic.read_rewards(spark, args.path), alpha=args.alpha).head().asDict()
    else:
        eps = generic.read_generic(spark, args.path, eager=True)
        df = (eps.completed() if args.completed_only else eps).df
        if args.command in ("report", "summary"):
            out = report.summary(df)
            lead = report.text_report(df) + "\n" if args.command == "report" else ""
        elif args.command == "taxonomy":
            out = [r.asDict() for r in taxonomy.compare_agents(taxonomy.task_profiles(df)).collect()]
        elif args.command == "compare":
            out = report.compare_models(df, args.a, args.b)
        else:
            gains = simulation.strategy_results(simulation.simulate_gains(df, args.replicates, args.seed))
            rounds = simulation.strategy_results(simulation.simulate_rounds(df, args.rounds, args.seed + 1), "rounds")
            out = {"gain": [r.asDict() for r in gains.collect()], "rounds": [r.asDict() for r in rounds.collect()]}
    text = json.dumps(out, indent=2, default=str)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    return lead + text


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as end:  # help ends with 0, a wrong command or flag with 1
        return 1 if end.code else 0
    spark = SparkSession.builder.getOrCreate()
    try:
        print({"engine": _engine, "train": _train}.get(args.command, _tables)(spark, args))
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
