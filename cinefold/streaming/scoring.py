"""Score a request stream against the published features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cinefold.functions.linear import LinearScorer, scorer_from
from cinefold.operators.lookup import key_bytes
from cinefold.operators.scoring import parse_requests, score_parsed
from cinefold.sources.predictions import COMPACT_EVERY, compact_predictions, write_outcomes
from cinefold.sources.registry import load_latest_model, load_model
from cinefold.sources.requests import with_line_order
from cinefold.sources.store import read_store


def resolve_model(model: PipelineModel | LinearScorer | str,
                  model_version: int | None = None) -> LinearScorer:
    """The scorer of a model, or of a version (else the latest) in a model directory."""
    if isinstance(model, str):
        model = load_model(model, model_version) if model_version else load_latest_model(model)
    return scorer_from(model)


def start_scoring(stream: DataFrame, store_dir: str, model: PipelineModel | LinearScorer | str,
                  out_dir: str, checkpoint: str, model_version: int | None = None,
                  available_now: bool = False, number_lines: bool = False,
                  compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """Start scoring; outcomes go to `out_dir`, progress to `checkpoint`.

    The model is fixed here and stays until the query stops. The newest feature snapshot
    is opened anew for each micro-batch, in the buckets that hold its keys. Every `compact_every`
    batches the latest predictions are compacted and the commit log is folded. `number_lines` is for text sources, whose lines
    carry no order of their own. Bound the micro-batches with the source's own options
    (`maxOffsetsPerTrigger`, `maxFilesPerTrigger`).
    """
    scorer = resolve_model(model, model_version)

    def score(batch: DataFrame, batch_id: int) -> None:
        requests = with_line_order(batch) if number_lines else batch
        parsed = parse_requests(requests).persist()
        try:
            store = read_store(batch.sparkSession, store_dir, keys=parsed)
            outcomes = score_parsed(parsed, store, scorer, key_bytes(parsed))
            write_outcomes(outcomes, out_dir, batch_id)
            if compact_every and (batch_id + 1) % compact_every == 0:
                compact_predictions(batch.sparkSession, out_dir)
        finally:
            parsed.unpersist()

    writer = stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
