"""Queries and checks for the pod-health operators."""

from __future__ import annotations

from ..operators import health as H
from ..sources.schemas import pods_from_json
from .fixtures import fixture, oracle

LIMIT = 20


def _pods(spark, sf_dir):
    return pods_from_json(fixture(spark, sf_dir, "pod_listing"))


def unhealthy_pods(spark, sf_dir):
    return H.unhealthy_pods(_pods(spark, sf_dir)).select("cluster", "namespace", "name", "reason")


def not_ready_pods(spark, sf_dir):
    return H.not_ready_pods(_pods(spark, sf_dir)).select("cluster", "namespace", "name", "reason")


def not_ready_pods_first(spark, sf_dir):
    found = H.not_ready_pods(_pods(spark, sf_dir), limit=LIMIT)
    return found.select("cluster", "namespace", "name", "reason")


QUERIES = {f.__name__: f for f in (unhealthy_pods, not_ready_pods, not_ready_pods_first)}

_POD = """
    pods as (select cluster, position, json_extract_string(pod, '$.metadata.namespace') as namespace,
                    json_extract_string(pod, '$.metadata.name') as name,
                    json_extract_string(pod, '$.status.phase') as phase,
                    coalesce(cast(json_extract(pod, '$.status.containerStatuses') as json[]), []) as conts,
                    coalesce(cast(json_extract(pod, '$.status.initContainerStatuses') as json[]), []) as inits,
                    coalesce(cast(json_extract(pod, '$.status.conditions') as json[]), []) as conds
             from pod_listing),
    cont as (select cluster, namespace, name, i, json_extract_string(c, '$.state.waiting.reason') as reason,
                    coalesce(cast(json_extract(c, '$.restartCount') as int), 0) as restarts,
                    coalesce(cast(json_extract(c, '$.ready') as boolean), false) as ready, init
             from (select cluster, namespace, name, false as init, unnest(conts) as c,
                          100 + unnest(range(0, len(conts))) as i from pods
                   union all
                   select cluster, namespace, name, true, unnest(inits), unnest(range(0, len(inits))) from pods) u),
    cond as (select cluster, namespace, name, json_extract_string(c, '$.type') as type,
                    json_extract_string(c, '$.status') as status
             from (select cluster, namespace, name, unnest(conds) as c from pods) u where
                    json_extract_string(c, '$.type') = 'PodScheduled')"""

_NOT_READY = f"""
    {_POD},
    stat as (select cluster, namespace, name, min_by(reason, i) filter (reason is not null) as reason,
                    bool_and(ready) filter (not init) as all_ready from cont group by all),
    judged as (select p.*, coalesce(s.reason, case when len(conts) = 0 and phase = 'Pending'
                        and coalesce(d.status, '') <> 'True' then 'Unschedulable'
                        when len(conts) = 0 then phase end, 'NotReady') as reason
               from pods p left join stat s using (cluster, namespace, name)
                    left join cond d using (cluster, namespace, name)
               where phase <> 'Succeeded' and not (phase = 'Running' and len(conts) > 0 and all_ready))"""

_REASONS = ", ".join(f"'{r}'" for r in H.STUCK_REASONS)

ORACLES = {
    "unhealthy_pods": oracle(
        f"""with {_POD},
            stuck as (select cluster, namespace, name, min_by((coalesce(reason, 'restarting'),), i) as hit from cont
                      where not init and (reason in ({_REASONS}) or restarts >= 3) group by all)
            select cluster, namespace, name, hit[1] as reason from stuck
            union all
            select p.cluster, p.namespace, p.name, 'Unschedulable' from pods p join cond d
              on p.cluster = d.cluster and p.namespace = d.namespace and p.name = d.name
            where phase = 'Pending' and len(conts) = 0 and d.status = 'False'""",
        "pod_listing",
    ),
    "not_ready_pods": oracle(
        f"with {_NOT_READY} select cluster, namespace, name, reason from judged", "pod_listing"
    ),
    "not_ready_pods_first": oracle(
        f"""with {_NOT_READY} select cluster, namespace, name, reason from judged
            qualify row_number() over (partition by cluster order by position) <= {LIMIT}""",
        "pod_listing",
    ),
}
