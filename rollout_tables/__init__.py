"""Spark jobs over instruction records, rollouts and rewards.

Subpackages:

* ``sources``   - readers, writers, split resolution and the derived test views
* ``functions`` - column expressions (completion parsing, score scaling, chat
                  rendering, token masking); no Python UDFs
* ``operators`` - DataFrame -> DataFrame jobs (SPLIT, PREP, PARSE, REWARD, REPORT)
* ``plans``     - the registered queries, their SQL oracles and plan checks
* ``streaming`` - the reward job run over rollout files as they arrive
"""

from rollout_tables.session import build_session, checkpoint_dir  # noqa: F401


def _pickle_by_value() -> None:
    """Python functions that run in tasks (the F10 evaluator hook, the
    tokenizer UDF) are pickled with their code, so executors need no copy of
    this package on their path."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # older cloudpickle: rely on the package being installed
        pass


_pickle_by_value()
