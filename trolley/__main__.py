"""python -m trolley MODEL: train a model on the star tables and write recommendations and mean metrics."""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import functions as F

from .functions.models import MODELS
from .operators import evaluation, interactions, ranking
from .session import session
from .sources.transactions import star_transactions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trolley")
    p.add_argument("model", choices=sorted(MODELS))
    p.add_argument("--data", required=True, help="folder of the star tables")
    p.add_argument("--out", help="folder for recommendations (parquet)")
    p.add_argument("--universe", choices=("part", "brand"), default="part")
    p.add_argument("--alpha", type=float)
    p.add_argument("--theta", type=float)
    p.add_argument("--graph", choices=("bn", "cos"))
    p.add_argument("--kind")
    p.add_argument("--kernel")
    p.add_argument("--topics", type=int)
    p.add_argument("--steps", type=int)
    p.add_argument("--baskets", type=int, default=-1, help="first baskets only; -1: all")
    p.add_argument("--n", type=int, default=10, help="recommendations a basket")
    p.add_argument("--novel", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> dict:
    a = parser().parse_args(argv)
    kind = MODELS[a.model]
    options = {f.name: getattr(a, f.name) for f in dataclasses.fields(kind) if getattr(a, f.name, None) is not None}
    spark = spark or session()
    train, test = interactions.split_by_date(star_transactions(spark, a.data, a.universe))
    ui = interactions.interactions(train)
    items = ranking.first_baskets(interactions.basket_items(test, ui), a.baskets)
    model = kind(**options).fit(ui)
    reco = model.recommend(items, a.n, "novel" if a.novel else "all")
    if a.out:
        reco.write.parquet(a.out)
        reco = spark.read.parquet(a.out)
    means = evaluation.mean_performance({"mean_prior": evaluation.mean_prior(reco, model.stats)}, items).first()
    out = {"model": a.model, "parameters": options, "baskets": items.select("basket").distinct().count(), "mean_prior": means["mean"], "recommendations": reco.agg(F.count("*")).first()[0]}
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
