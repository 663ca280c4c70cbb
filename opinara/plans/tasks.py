"""Summaries of long reviews and a reply to a question review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from opinara.functions import constants as C
from opinara.operators import generate as G
from opinara.session import checkpointed
from opinara.sources.results import write_generation_payload


def run_tasks(
    reviews: DataFrame,
    factory: Callable[[], G.Generate],
    output_path: str,
    model_name: str = "custom",
    device: int = -1,
    seed: int = 42,
    n_summaries: int = 10,
    partitions: int = 2,
) -> DataFrame:
    """Select, prompt, generate, assemble and write; refuses when nothing qualifies."""
    question = G.first_row(G.question_reviews(reviews), require=True)
    long = G.summary_reviews(reviews, n_summaries, seed, require=True)
    summaries = checkpointed(
        G.generate_text(
            G.with_summary_prompt(long), factory, C.SUMMARY_TOKENS, "summary", partitions
        )
    )
    reply = checkpointed(
        G.generate_text(G.with_service_prompt(question), factory, C.SERVICE_TOKENS, "response")
    )
    payload = G.generation_payload(summaries, reply, model_name, device, seed)
    write_generation_payload(payload, output_path)
    return payload
