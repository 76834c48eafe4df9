"""A large group of vectors, most of whose pairs are links, keeps them."""

import numpy as np

from voxledger.llm import embedding


def test_links_of_a_hot_group_are_found(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    hot = centre + np.sqrt((1 / 0.9 - 1) / 64) * rng.standard_normal((1_500, 64))
    x = np.vstack([hot, rng.standard_normal((3_000, 64))]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = embedding.near_duplicates(df, "vec_id", "embedding").collect()
    assert all(r["n_links"] <= hit[r["vec_id"]].sum() for r in got)
    assert sum(r["n_links"] for r in got) >= 0.99 * hit.sum()
