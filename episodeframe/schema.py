"""Tables of the data model as Spark types.

``ord`` fixes the order of rows where order matters (first record wins ties,
positional indices); Spark itself keeps none.
"""

from __future__ import annotations

from pyspark.sql import types as T

EPISODE = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("task", T.StringType(), False),
        T.StructField("episode", T.IntegerType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("success", T.BooleanType(), False),
        T.StructField("strata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("failure_mode", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("trajectory_ref", T.StringType()),
        T.StructField("meta", T.StringType()),
        T.StructField("ord", T.LongType(), False),
    ]
)

TOOL_CALL = T.StructType([T.StructField("function_name", T.StringType()), T.StructField("tool_use_name", T.StringType()), T.StructField("arguments", T.StringType()), T.StructField("tool_call_id", T.StringType())])
OBSERVATION = T.StructType([T.StructField("results", T.ArrayType(T.StructType([T.StructField("source_call_id", T.StringType()), T.StructField("output", T.StringType())])))])
STEP = T.StructType([T.StructField("step_id", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("message", T.StringType()), T.StructField("tool_calls", T.ArrayType(TOOL_CALL)), T.StructField("observation", OBSERVATION)])
TRAJECTORY = T.StructType([T.StructField("steps", T.ArrayType(STEP))])

MEMORY = T.StructType(
    [
        T.StructField("trial_id", T.StringType()),
        T.StructField("task_path", T.StringType()),
        T.StructField("agent_name", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("tool_sequence", T.ArrayType(T.StringType())),
        T.StructField("traj_path", T.StringType()),
        T.StructField("n_steps", T.IntegerType()),
        T.StructField("first_write_pos", T.IntegerType()),
        T.StructField("n_exec", T.IntegerType()),
        T.StructField("n_search", T.IntegerType()),
    ]
)

POOL = T.StructType(
    [
        T.StructField("agent_name", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("checkpoint_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("trajectory_ref", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("failure_mode", T.StringType()),
        T.StructField("sub_task_depth", T.IntegerType()),
        T.StructField("ord", T.LongType()),
    ]
)

STRATUM = "s_"
