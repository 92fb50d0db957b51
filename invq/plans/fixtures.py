"""Inventory tables derived from the supplied tables.

One SQL text per table, in the dialect Spark and DuckDB share, so both sides of a check start
from the same rows. ``{orders}`` and the like stand for a supplied table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def dotted(lo: str) -> str:
    """SQL text of an address; ``lo`` is a bigint expression."""
    octets = [f"cast(cast(floor({lo} / {2**s}) as bigint) % 256 as string)" for s in (24, 16, 8, 0)]
    return "concat(" + ", '.', ".join(octets) + ")"


def size(prefix: str) -> str:
    return f"cast(power(2, 32 - ({prefix})) as bigint)"


TEN = 167772160  # 10.0.0.0

FIXTURES = {
    "range_wanted": f"""
        select range_id, vpc_id, zones, is_public, non_interactive, prefix, lo,
               concat({dotted('lo')}, '/', cast(prefix as string)) as cidr
        from (select range_id, vpc_id, zones, is_public, non_interactive, prefix,
                     raw - raw % {size('prefix')} as lo
              from (select c_custkey as range_id, cast(floor(c_custkey / 10) as bigint) as vpc_id,
                           cast(1 + c_custkey % 3 as int) as zones,
                           c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') as is_public,
                           c_acctbal < 0 as non_interactive,
                           cast(16 + c_custkey % 5 as int) as prefix,
                           cast({TEN} as bigint) + (c_custkey * 7919 % 1024) * 4096 as raw
                    from {{customer}}) a) b""",
    "range_text": f"""
        select range_id, zones,
               case range_id % 11
                    when 0 then concat({dotted('lo + 1')}, '/', cast(prefix as string))
                    when 1 then 'not-a-range'
                    when 2 then concat({dotted('lo - lo % 2097152')}, '/11')
                    when 3 then concat('11.', cast(range_id % 256 as string), '.0.0/16')
                    when 4 then concat({dotted('lo')}, '/24')
                    when 5 then 'fd00::/16'
                    when 6 then '10.256.0.0/16'
                    when 7 then '010.0.0.0/16'
                    else concat({dotted('lo')}, '/', cast(prefix as string)) end as cidr
        from (select range_id, prefix, cast(1 + range_id % 5 as int) as zones,
                     raw - raw % {size('prefix')} as lo
              from (select c_custkey as range_id, cast(16 + c_custkey % 5 as int) as prefix,
                           case when c_nationkey % 2 = 0 then cast(2886729728 as bigint)
                                else cast({TEN} as bigint) end + (c_custkey * 7919 % 256) * 4096 as raw
                    from {{customer}}) a) b""",
    "subnet_existing": f"""
        select subnet_id, vpc_id, zone, is_ours, prefix, lo,
               concat({dotted('lo')}, '/', cast(prefix as string)) as cidr
        from (select subnet_id, vpc_id, zone, is_ours, prefix, raw - raw % {size('prefix')} as lo
              from (select o_orderkey as subnet_id, cast(floor(o_custkey / 10) as bigint) as vpc_id,
                           cast(o_orderkey % 3 as int) as zone,
                           cast(18 + o_orderkey % 9 as int) as prefix,
                           cast({TEN} as bigint) + (o_orderkey * 104729 % 16384) * 256 as raw,
                           o_orderpriority = '1-URGENT' as is_ours
                    from {{orders}}) a) b""",
    # one row per block a network carries; blocks of 172.16/12 and 192.168/16 too, some released
    "vpc_block": f"""
        select vpc_id, position, state, prefix, lo,
               concat({dotted('lo')}, '/', cast(prefix as string)) as cidr
        from (select vpc_id, position, state, prefix, raw - raw % {size('prefix')} as lo
              from (select cast(floor(c_custkey / 10) as bigint) as vpc_id, c_custkey as position,
                           case when c_acctbal < 500 then 'disassociated' else 'associated' end as state,
                           cast(14 + c_custkey % 6 as int) as prefix,
                           case cast(floor(c_custkey / 10) as bigint) % 5
                                when 0 then cast(2886729728 as bigint)
                                when 1 then cast(3232235520 as bigint)
                                else cast({TEN} as bigint) end
                             + (c_custkey * 7919 % 16) * 4096 + case when c_custkey % 7 = 0 then 262144 else 0 end
                             as raw
                    from {{customer}}) a) b""",
    # several prefixes per network as one text, some of them unreadable
    "network_listing": f"""
        select network_id, account, concat({dotted('lo')}, '/', cast(prefix as string),
               case when network_id % 4 = 0 then concat(',', {dotted('lo + 1048576')}, '/28')
                    when network_id % 4 = 1 then ',10.1.2.3/8' when network_id % 4 = 2 then ',none'
                    else '' end) as prefixes
        from (select network_id, account, prefix, raw - raw % {size('prefix')} as lo
              from (select o_orderkey as network_id, cast(floor(o_custkey / 10) as bigint) as account,
                           cast(18 + o_orderkey % 9 as int) as prefix,
                           cast({TEN} as bigint) + (o_orderkey * 104729 % 16384) * 256 as raw
                    from {{orders}}) a) b""",
    # ranges near the fixed blocks and near the end of the address space
    "range_edge": f"""
        select range_id, prefix, lo, concat({dotted('lo')}, '/', cast(prefix as string)) as cidr
        from (select range_id, prefix, raw - raw % {size('prefix')} as lo
              from (select o_orderkey as range_id, cast(16 + o_orderkey % 5 as int) as prefix,
                           case o_orderstatus when 'F' then cast(1879048192 as bigint) - 131072
                                when 'O' then cast(4294967296 as bigint) - 262144
                                else cast({TEN} as bigint) + 6422528 end
                             + (o_orderkey * 7919 % 64) * 4096 as raw
                    from {{orders}}) a) b""",
}

# credential-shaped text is put together from pieces when the query runs
_SECRET = """case {id} % 9
        when 0 then concat(' key=', md5(cast({id} as string)), ' end')
        when 1 then concat(' pc', 'sk', '_', md5(cast({id} as string)), ' ', 'pu', 'l-', md5(cast({id} as string)))
        when 2 then concat(' AK', 'IA', upper(substring(md5(cast({id} as string)), 1, 16)), '.')
        when 3 then concat(' e', 'y', md5(cast({id} as string)), '.', md5('a'), '.', md5('b'), ' ')
        when 4 then concat(' postgres', '://user:', md5(cast({id} as string)), '@db.internal:5432/x')
        when 5 then concat(' commit ', md5(cast({id} as string)), '0123abcd done')
        else '' end"""

FIXTURES |= {
    "log_text": "select 'documents' as source, doc_id as id, concat(text, "
    + _SECRET.format(id="doc_id")
    + ") as text from {documents} union all select 'pages', page_id, concat(html, "
    + _SECRET.format(id="page_id")
    + ") from {pages} union all select 'conversations', conv_id * 1000 + turn, concat(text, "
    + _SECRET.format(id="(conv_id * 1000 + turn)")
    + ") from {conversations}",
    "log_line": "select event_id as id, case when event_type in ('view', 'error') then 'lib' else 'root' end as logger, "
    "concat(event_type, case user_id % 4 when 0 then concat(' update --name   clu-', cast(user_id as string), ' ok') "
    "when 1 then concat(' server: https://h', cast(user_id as string), '.example:443') else ' plain' end, "
    + _SECRET.format(id="event_id")
    + ") as line from {events}",
    "probe_log": """
        select user_id as probe_id, event_id, ts, concat('attempt ', cast(event_id as string), ': ',
               case event_type when 'error' then '000' when 'view' then '200' when 'click' then '503'
                    else '404' end) as line
        from {events}""",
    "pod_listing": """
        select cast(floor(event_id / 100) as bigint) as cluster, event_id as position,
               concat('{"metadata":{"namespace":"ns-', cast(user_id % 7 as string), '","name":"pod-',
                 cast(event_id as string), '"},"status":{"phase":"',
                 case event_type when 'signup' then 'Pending' when 'error' then 'Failed'
                      when 'view' then 'Succeeded' else 'Running' end, '"',
                 case when user_id % 3 = 0 then concat(',"conditions":[{"type":"Ready","status":"False"},',
                      '{"type":"PodScheduled","status":"', case when event_id % 2 = 0 then 'False' else 'True' end, '"}]')
                      else '' end,
                 case event_id % 5
                      when 0 then ''
                      when 1 then ',"containerStatuses":[{"ready":true,"restartCount":0,"state":{}}]'
                      when 2 then concat(',"containerStatuses":[{"ready":true,"restartCount":', cast(user_id % 6 as string),
                        ',"state":{}},{"ready":false,"restartCount":1,"state":{"waiting":{"reason":"',
                        case user_id % 4 when 0 then 'CrashLoopBackOff' when 1 then 'ErrImagePull'
                             when 2 then 'ContainerCreating' else 'CreateContainerError' end, '"}}}]')
                      when 3 then ',"containerStatuses":[{"ready":false,"restartCount":4}]'
                      else ',"containerStatuses":[{"ready":true,"restartCount":2},{"ready":true}]' end,
                 case when user_id % 5 = 0 then
                      ',"initContainerStatuses":[{"state":{"waiting":{"reason":"ImagePullBackOff"}}}]' else '' end,
                 '}}') as pod
        from {events}""",
}

_TABLE = re.compile(r"\{([a-z]+)\}")


def spark_sql(sql: str, sf_dir: str) -> str:
    return _TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", sql)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_sql(FIXTURES[name], sf_dir))


def supplied(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(query: str, *names: str) -> str:
    """``query`` with the named derived tables defined in front of it, for DuckDB."""
    parts = [f"{n} as ({_TABLE.sub(lambda m: m.group(1), FIXTURES[n])})" for n in names]
    query = query.strip()
    if not parts:
        return query
    if query.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + query[5:]
    return "with " + ",\n".join(parts) + "\n" + query

FIXTURES |= {
    "usage": """
        select o_custkey as account, case o_orderstatus when 'F' then 'vpc' when 'O' then 'eip' else 'balancer' end as resource,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'application' else 'network' end as kind
        from {orders}""",
    "quota": """
        select account, resource, needed, fallback, provider_default,
               case when c_acctbal < 0 then cast(0 as double) when n = 3 then null else n / 4.0 + 1.75 end as applied
        from (select c_custkey as account, 'vpc' as resource, 1 as needed, 5 as fallback, c_acctbal,
                     cast(5 as double) as provider_default, c_nationkey % 9 as n from {customer}
              union all select c_custkey, 'eip', 1 + c_nationkey % 3, 5, c_acctbal, cast(null as double), c_nationkey % 7 from {customer}
              union all select c_custkey, 'balancer', 1, 50, c_acctbal, cast(4 as double), c_nationkey % 5 from {customer}) q""",
    "nat_gateway": """
        select l_partkey as gateway_id, l_orderkey as subnet_id,
               case l_returnflag when 'R' then 'deleted' when 'A' then 'available' else 'pending' end as state
        from {lineitem}""",
    "enabled": "select o_custkey as account, o_orderpriority as item from {orders}",
    "offering": """
        select cast(floor(l_orderkey / 20) as bigint) as account, p_brand as item,
               cast(l_suppkey % 4 as int) as zone
        from {lineitem} join {part} on l_partkey = p_partkey""",
    "zone_request": """
        select o_orderkey as request_id, cast(floor(o_orderkey / 20) as bigint) as account,
               case o_orderstatus when 'F' then '0' when 'O' then '1,0' else '0,5,2' end as zones
        from {orders}""",
    "sku_listing": """
        select cast(floor(o_orderkey / 60) as bigint) as region, o_orderkey as position,
               o_orderpriority as name,
               case when o_orderstatus = 'F' and o_totalprice > 400000 then 'disks' else 'virtualMachines' end as resource_type,
               case o_orderstatus when 'F' then 'a,b' when 'O' then 'b,c' else 'a,b,c' end as zones,
               case when o_totalprice < 60000 then 'b' when o_totalprice < 90000 then 'a,c' else '' end as barred_zones,
               case when o_totalprice > 450000 then 'Location' else 'Zone' end as barred_by
        from {orders}""",
    "server_listing": """
        select s_suppkey as region,
               case when s_acctbal < 1000 then '[]' else
               concat('[{"reason":', case when s_acctbal < 2500 then '"Provisioning is Restricted here"' else 'null' end,
                 ',"supportedServerEditions":[{"name":"Burstable","supportedServerSkus":[{"name":"Standard_D2s_v3"}]},',
                 '{"name":"', case when s_acctbal < 5000 then 'GeneralPurpose' else 'MemoryOptimized' end,
                 '","supportedServerSkus":[{"name":"x"},{"name":"', case when s_nationkey < 13 then 'Standard_D2s_v3' else 'y' end,
                 '"}]}]},{"reason":"restricted"}]') end as listing
        from {supplier}""",
    "check_result": """
        select l_orderkey as deployment, l_returnflag <> 'R' or l_quantity < 25 as passed,
               case cast(l_partkey % 20 as int) when 0 then 'VPC Quota' when 1 then 'Elastic IPs' when 2 then 'NAT Gateways'
                 when 3 then 'Internet Gateways' when 4 then 'EKS Clusters' when 5 then 'Network Load Balancers'
                 when 6 then 'Availability Zones' when 7 then 'Instance Types' when 8 then 'VPC CIDR' when 9 then 'VPC Exists'
                 when 10 then 'VPC DNS' when 11 then 'VPC Permissions' when 12 then 'Subnet Egress' when 13 then 'Internet Gateway'
                 when 14 then 'EKS Cluster Quota' when 15 then 'GCP APIs' when 16 then 'GKE Clusters' when 17 then 'vCPU Quota'
                 when 18 then 'VNet CIDR' else 'Something New' end as name
        from {lineitem}""",
    "deployment": """
        select o_orderkey as deployment, o_custkey as vpc_id, o_orderstatus <> 'F' as in_their_network,
               o_orderpriority in ('1-URGENT', '3-MEDIUM') as is_public
        from {orders}""",
    "saved_zones": """
        select o_orderkey as id, case o_orderpriority when '1-URGENT' then '' when '2-HIGH' then 'a, b'
                 when '3-MEDIUM' then 'c' when '5-LOW' then 'z,a' else null end as saved,
               case o_orderstatus when 'F' then 'a,b,c' when 'O' then 'b' else 'c,a,d' end as available
        from {orders}""",
    "probe_answer": """
        select l_orderkey as deployment,
               case l_linenumber when 1 then 'ec2:CreateSubnet' when 2 then 'ec2:CreateSecurityGroup'
                    when 3 then 'ec2:CreateRouteTable' else 'ec2:AssociateRouteTable' end as action,
               case when l_linenumber > 3 then concat('rtb-', cast(l_suppkey % 5 as string)) end as table_id,
               case when l_returnflag = 'R' and l_quantity < 20 then 'UnauthorizedOperation'
                    when l_returnflag = 'A' then 'DryRunOperation' when l_linestatus = 'O' then 'RequestLimitExceeded'
                    else 'InvalidSubnetRange' end as error_code
        from {lineitem}""",
    "state_resource": """
        select l_orderkey as stack,
               concat('{"arn":"', case when l_returnflag = 'R' then concat('arn:aws:ec2:us-east-2:',
                        lpad(cast(l_suppkey % 3 as string), 12, '0'), ':vpc/x","role":"arn:aws:iam::',
                        lpad(cast(l_partkey % 4 as string), 12, '0'), ':role/y') else 'none' end, '"}') as outputs,
               case l_linenumber when 1 then 'aws:ec2/vpc:Vpc' when 2 then 'aws:ec2/natGateway:NatGateway'
                 when 3 then 'aws:ec2/routeTable:RouteTable' when 4 then 'aws:ec2/vpcIpv4CidrBlockAssociation:VpcIpv4CidrBlockAssociation'
                 when 5 then case l_returnflag when 'A' then 'aws:eks/cluster:Cluster' when 'N' then 'kubernetes:apps/v1' else 'aws:rds/x' end
                 else 'aws:ec2/subnet:Subnet' end as type,
               concat('urn::p::', case when l_quantity > 48 then 'pc-api-key' else 'pc-vpc' end) as urn,
               case when l_suppkey % 2 = 0 then o_custkey end as vpc_id
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "caller": "select o_orderkey as stack, lpad(cast(o_custkey % 3 as string), 12, '0') as caller from {orders}",
    "stack": """
        select o_orderkey as stack, case o_orderstatus when 'F' then 'own' when 'O' then 'existing' else 'private' end as shape,
               cast(1 + o_custkey % 2 as int) as n_zones, o_custkey as expected_vpc_id
        from {orders}""",
    "balancer": """
        select o_custkey as vpc_id, case when l_returnflag = 'R' and l_tax > 0.06 then 'internet-facing' else 'internal' end as scheme
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "ingress": """
        select l_orderkey as deployment, case when l_returnflag = 'N' then 'other' else 'gloo-system' end as namespace,
               case l_linenumber when 1 then 'gloo-lb' when 2 then 'gloo-lb-http1' when 3 then 'x' else 'private-gloo-lb' end as name
        from {lineitem}""",
    "stack_listing": """
        select concat('org/', case when o_orderstatus = 'F' then 'p' else 'q' end, '/ci-', case o_orderpriority
                 when '1-URGENT' then 'aws-' when '2-HIGH' then 'gcp-' when '3-MEDIUM' then 'azure-' else '' end,
                 cast(o_orderkey as string)) as qualified
        from {orders}""",
    "stack_gone": """
        select concat('ci-', case when c_acctbal < 2000 then 'aws-' when c_acctbal < 4000 then 'gcp-'
                 when c_acctbal < 6000 then 'azure-' else '' end, cast(c_custkey as string)) as name
        from {customer}""",
    "cluster_listing": """
        select cast(floor(o_custkey / 10) as bigint) as region, o_custkey as vpc_id,
               concat('clu-', lpad(cast(o_orderkey % 1000 as string), 4, '0'), '-', cast(o_orderkey as string)) as name,
               o_orderstatus as status
        from {orders}""",
    "cluster_request": """
        select c_custkey as request_id, cast(floor(c_custkey / 10) as bigint) as region,
               case when c_acctbal > 3000 then c_custkey end as vpc_id, c_mktsegment <> 'BUILDING' as has_baseline
        from {customer}""",
}

_TABLE_ID = "concat('rtb-', cast(o_custkey as string), '-', cast(o_orderkey % 4 as string))"

FIXTURES |= {
    # a position can repeat; tie makes the order total
    "route": f"""
        select table_id, position, destination, state, nat_gateway_id, transit_gateway_id, gateway_id, peering_id,
               concat(state, coalesce(nat_gateway_id, ''), transit_gateway_id, coalesce(gateway_id, ''), coalesce(peering_id, '')) as tie
        from (select {_TABLE_ID} as table_id, l_orderkey * 10 + l_linenumber as position,
                     case when l_linenumber < 3 then '0.0.0.0/0' else '10.0.0.0/8' end as destination,
                     case when l_tax < 0.05 then 'active' else 'blackhole' end as state,
                     case when l_returnflag = 'R' then concat('nat-', cast(l_partkey as string)) end as nat_gateway_id,
                     case when l_quantity > 45 then concat('tgw-', cast(l_partkey as string)) else '' end as transit_gateway_id,
                     case when l_returnflag = 'A' and l_quantity < 8 then concat('vgw-', cast(l_partkey as string))
                          when l_returnflag = 'A' then concat('igw-', cast(l_partkey as string)) end as gateway_id,
                     case when l_returnflag = 'N' and l_quantity < 20 then concat('pcx-', cast(l_partkey as string)) end as peering_id
              from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey) r""",
    "association": f"""
        select {_TABLE_ID} as table_id, o_custkey as vpc_id, o_orderkey as subnet_id, false as main from {{orders}}
        union all
        select concat('rtb-', cast(c_custkey as string), '-0'), c_custkey, cast(null as bigint), true from {{customer}}""",
    "egress_subnet": "select o_orderkey as subnet_id, o_custkey as vpc_id, cast(length(o_orderpriority) % 3 as int) as zone from {orders}",
    "egress_zone": """
        select vpc_id, zone, case when c_acctbal < 2000 and zone <> 1 then concat('rtb-', cast(vpc_id as string), '-', cast(zone as string)) end as named
        from (select c_custkey as vpc_id, 0 as zone, c_acctbal from {customer}
              union all select c_custkey, 1, c_acctbal from {customer}
              union all select c_custkey, 2, c_acctbal from {customer}) z""",
}

_RECORD = """
        select o_orderkey as id,
               case o_orderkey % 8 when 0 then 'environment' when 1 then 'api_key' when 2 then 'dns_delegation'
                    when 3 then 'metrics_key' when 4 then 'uninstaller' when 5 then 'service_account'
                    when 6 then 'metrics_access' else 'gateway_key' end as kind, {fields}
        from {{orders}} where o_orderpriority <> '{absent}'"""

FIXTURES |= {
    "record_old": _RECORD.format(
        absent="1-URGENT",
        fields="""case when o_totalprice < 30000 then null when o_totalprice < 40000 then '' else cast(o_custkey as string) end as a,
               case when o_custkey % 2 = 0 then 'AWS' else 'gcp' end as b, o_orderpriority as c,
               case when o_totalprice > 300000 then 'false' end as d""",
    ),
    "record_new": _RECORD.format(
        absent="5-LOW",
        fields="""case when o_totalprice > 200000 then 'fresh' end as a,
               case when o_custkey % 2 = 0 and o_totalprice < 250000 then 'aws' when o_totalprice > 420000 then 'azure'
                    when o_custkey % 2 = 0 then 'AWS' else 'gcp' end as b,
               case when o_totalprice > 380000 and o_totalprice < 400000 then 'moved' else o_orderpriority end as c,
               case when o_totalprice > 320000 then 'false' when o_totalprice > 100000 then 'true' end as d""",
    ),
    "tagged": """
        select o_orderkey as id, case o_orderstatus when 'F' then 'aws' when 'O' then 'gcp' else 'azure' end as cloud,
               case when o_totalprice > 250000 then 'prod' else 'staging' end as env,
               case when o_custkey % 3 = 0 then concat('team', cast(o_custkey as string)) end as owner,
               concat('n', cast(o_orderkey as string)) as name, o_orderpriority = '1-URGENT' as has_extra
        from {orders}""",
    "setting": """
        select l_orderkey as scope, case l_linenumber when 1 then 'api_url' when 2 then 'cidr' when 3 then 'domain'
                 when 4 then 'env' when 5 then 'key' when 6 then 'region' else 'zones' end as key,
               case l_returnflag when 'A' then 'env' when 'N' then 'saved' else 'default' end as layer,
               case when l_quantity < 10 then '' else concat('v', cast(l_partkey as string)) end as value
        from {lineitem}""",
    "keyvalue": """
        select o_orderkey as id,
               concat(' team = a', cast(o_custkey as string), case o_orderstatus when 'F' then ',noval,x=' when 'O' then ', team=b=c=d ,,y = 1'
                      else ',=z,  ' end, ',tier=', o_orderpriority) as tags,
               concat('us-1a = rtb-', cast(o_custkey as string), case o_orderstatus when 'F' then ', us-1a=rtb-2,=rtb-3' when 'O' then ',us-1b=nope,,rtb-9'
                      else '' end) as zone_tables,
               concat('export A=1', chr(10), '# note', chr(10), 'export B=', o_orderpriority, '=x', chr(10),
                      case o_orderstatus when 'F' then 'export A=2' when 'O' then 'export BROKEN' else 'exported C=3' end) as exports
        from {orders}""",
    "object": """
        select concat(case l_partkey % 6 when 0 then 'activity-scrapes/' when 1 then 'janitor/' when 2 then 'lag-reporter/'
                      when 3 then 'data/activity-scrapes/' when 4 then 'internal/lag-reporter/' else 'data/' end, cast(l_partkey as string)) as object_key,
               l_shipdate as modified, l_returnflag <> 'R' as is_current,
               case when l_returnflag = 'R' and l_linestatus = 'O' then l_shipdate + interval '9' day
                    when l_returnflag = 'R' then l_shipdate + interval '1' day end as noncurrent_since
        from {lineitem}""",
    "object_listed": """
        select l_suppkey % 50 as account, concat(case l_partkey % 6 when 0 then 'activity-scrapes/' when 1 then 'janitor/' when 2 then 'lag-reporter/'
                      when 3 then 'data/activity-scrapes/' when 4 then 'internal/lag-reporter/' else 'data/' end, cast(l_partkey as string)) as object_key,
               l_shipdate as modified, l_returnflag <> 'R' as is_current,
               case when l_returnflag = 'R' and l_linestatus = 'O' then l_shipdate + interval '9' day
                    when l_returnflag = 'R' then l_shipdate + interval '1' day end as noncurrent_since
        from {lineitem}""",
    "retention_rule": """
        select p_partkey % 50 as account, concat('r', cast(p_partkey as string)) as rule,
               case p_partkey % 7 when 0 then 'janitor/' when 1 then 'data/' when 2 then concat('data/', cast(p_partkey % 90 as string))
                    when 3 then 'internal/lag-reporter/' when 4 then concat('activity-scrapes/', cast(p_partkey as string))
                    when 5 then 'lag-reporter/absent/' else case when p_partkey % 35 = 6 then '' else 'jan' end end as prefix,
               cast(20 + p_size * 37 as int) as days, case when p_partkey % 4 = 1 then 'noncurrent_since' else 'modified' end as clock,
               p_partkey % 3 <> 0 as inclusive,
               case p_partkey % 4 when 0 then 'current' when 1 then 'noncurrent' else 'any' end as applies_to
        from {part}""",
    "tenant": """
        select c_custkey as id, concat(case when c_nationkey % 5 = 0 then 'My byoc ' else 'Acme_' end, c_mktsegment, ' Group ',
                 cast(c_nationkey as string)) as organisation,
               concat('env-', substring(md5(cast(c_custkey as string)), 1, 1 + c_nationkey), '.svc.example') as environment,
               concat('pool-', c_mktsegment, '_', cast(c_custkey as string)) as pool
        from {customer}""",
    "namespace_listed": """
        select cast(floor(o_custkey / 10) as bigint) as cluster, case o_orderstatus when 'F' then concat('pc-', cast(o_custkey as string))
                 when 'O' then concat('x-', cast(o_custkey as string)) else '' end as name from {orders}""",
    "namespace": """
        select cast(floor(o_custkey / 10) as bigint) as cluster, case o_orderpriority when '1-URGENT' then 'metering'
                 when '2-HIGH' then 'default' else concat('pc-', cast(o_custkey as string)) end as name from {orders}""",
    "pool_config": """
        select o_orderkey as id, case o_orderstatus when 'F' then '[]' else concat('[{"name":"main","max_size":', cast(o_custkey as string),
                 ',"labels":{"tier":"', o_orderpriority, '","nodepool":"own"}},{"name":"side","instance_type":"m.x","taints":[{"key":"k","value":"',
                 cast(o_custkey as string), case when o_orderpriority = '5-LOW' then '","effect":"NO_EXECUTE"' else '"' end, '}]}]') end as pools
        from {orders}""",
}

FIXTURES |= {
    # one listing a day per cluster, one in ten of them failed
    "poll": """
        select cluster, poll_seq, min(ts) as ts, poll_seq % 10 <> 4 as poll_ok
        from (select user_id % 3 as cluster, cast(extract(year from ts) * 372 + extract(month from ts) * 31 + extract(day from ts) as bigint)
                     as poll_seq, ts from {events}) e
        group by cluster, poll_seq""",
    "poll_seen": """
        select distinct user_id % 3 as cluster,
               cast(extract(year from ts) * 372 + extract(month from ts) * 31 + extract(day from ts) as bigint) as poll_seq, user_id
        from {events}""",
    "pod_sighting": """
        select concat(case event_type when 'error' then 'tool-' when 'view' then 'tools-' else 'app-' end,
               cast(user_id as string)) as name, ts from {events}""",
    "attempt": """
        select user_id as target, event_id, ts, case event_type when 'view' then 200 when 'click' then 503 when 'signup' then 404 end as status,
               concat(event_type, ' at ', cast(event_id as string)) as failure
        from {events}""",
    "job_poll": """
        select cast(floor(event_id / 20) as bigint) as job, ts,
               case when event_type = 'purchase' and value > 50 then 1 else 0 end as succeeded,
               case when event_type = 'error' and value > 40 then 2 else 0 end as failed,
               event_type <> 'click' or value < 60 as found
        from {events}""",
    "verify_poll": """
        select cast(floor(event_id / 40) as bigint) as service, cast(event_id % 40 as int) as attempt,
               case when event_type = 'purchase' and value > 80 then 'verified' when event_type = 'error' and value > 90 then 'failed'
                    else 'pendingVerification' end as state
        from {events}""",
}
