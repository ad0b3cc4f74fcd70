"""The analytic queries; every function takes DataFrames and returns a lazy DataFrame.

dashboard – one-scan grouping sets and their sections; leaders – top providers
per sector / state / code; providers – search, peers, provider index; rows –
paging and largest rows; cubes – materialised aggregates and their roll-ups;
stats – dataset statistics and distinct lists; topk – shared top-k helpers.
"""
