"""Times the headline queries and prints one JSON line: the median of three runs each."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from noisemix.operators.lexicon import mark_proper_nouns
from noisemix.operators.noise import prepare
from noisemix.plans.registered import QUERIES
from noisemix.plans.text_queries import KEYS, lexicon
from noisemix.session import local_session
from noisemix.sources.corpora import denoising_pairs

HEADLINE = [
    "e3_changed_rate",
    "c1_typo_noise",
    "c5_runon_line",
    "c6_multiline_runon",
    "c10_compound_runon",
    "c11_named_recipes",
    "f7_mix",
    "e4_word_bleu",
    "e7_word_error_rate",
    "e8_meteor",
    "e1_noise_report",
    "e11_joint_dictionary",
    "f8_token_batches",
    "d8_apply_dictionary",
    "d8_apply_dictionary_by_join",
    "h1_train_merges",
    "h2_encode",
]


def marked_by_join(spark, sf_dir):
    """The path that a lexicon too large for the plan takes."""
    lines = denoising_pairs(spark, sf_dir).transform(prepare(KEYS))
    return mark_proper_nouns(lines, lexicon(spark, sf_dir), KEYS, inline_words=0)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cores, int(cores))
    times = {}

    def run(query) -> float:
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(QUERIES["d2_align_kinds"])  # warms the JVM
    times["lexicon_mined"] = round(run(lexicon), 3)  # once: later queries reuse the table
    todo = {key: QUERIES[key] for key in HEADLINE} | {"k2_mark_by_join": marked_by_join}
    for key, query in todo.items():
        times[key] = round(median(run(query) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
