"""The registered queries of the subpackage and the SQL that must agree with them."""

from . import curve_pack, divergence_rules, hidden_markov, jaccard_regions, multi_index, pivotal_mix, quality_net, secret_battery, tiered_shards, token_output

_MODULES = (curve_pack, divergence_rules, hidden_markov, jaccard_regions, multi_index, pivotal_mix, quality_net, secret_battery, tiered_shards, token_output)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
