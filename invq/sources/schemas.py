"""Explicit schemas of landed inventory, and the columns the operators expect of them.

Listings are read PERMISSIVE with a fixed schema: a missing field is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTAINER = "array<struct<ready:boolean,restartCount:int,state:struct<waiting:struct<reason:string>>>>"
POD = (
    "struct<metadata:struct<namespace:string,name:string>,"
    "status:struct<phase:string,conditions:array<struct<type:string,status:string>>,"
    f"containerStatuses:{_CONTAINER},initContainerStatuses:{_CONTAINER}>>"
)
ROUTE_TABLE = (
    "struct<RouteTableId:string,VpcId:string,"
    "Associations:array<struct<SubnetId:string,Main:boolean>>,"
    "Routes:array<struct<DestinationCidrBlock:string,State:string,NatGatewayId:string,"
    "TransitGatewayId:string,VpcEndpointId:string,NetworkInterfaceId:string,InstanceId:string,"
    "CoreNetworkArn:string,GatewayId:string,VpcPeeringConnectionId:string>>>"
)
SERVER_SKUS = (
    "array<struct<reason:string,supportedServerEditions:array<struct<name:string,"
    "supportedServerSkus:array<struct<name:string>>>>>>"
)
SKU = (
    "struct<name:string,resourceType:string,locationInfo:array<struct<zones:array<string>>>,"
    "restrictions:array<struct<type:string,restrictionInfo:struct<zones:array<string>>>>>"
)
VPC = (
    "struct<VpcId:string,CidrBlock:string,CidrBlockAssociationSet:array<struct<CidrBlock:string,"
    "CidrBlockState:struct<State:string>>>,Tags:array<struct<Key:string,Value:string>>>"
)
STATE_EXPORT = (
    "struct<deployment:struct<resources:array<struct<type:string,urn:string,"
    "outputs:struct<vpcId:string>>>>>"
)
NODE_POOL = (
    "struct<name:string,instance_type:string,min_size:int,max_size:int,desired_size:int,"
    "disk_size_gb:int,labels:map<string,string>,"
    "taints:array<struct<key:string,value:string,effect:string>>>"
)


def tag_map(tags: Column) -> Column:
    """Map of a Key/Value list; the first of a repeated key counts, as a lookup by key finds it."""
    return F.aggregate(
        F.coalesce(tags, F.array().cast("array<struct<Key:string,Value:string>>")),
        F.create_map().cast("map<string,string>"),
        lambda seen, tag: F.when(F.map_contains_key(seen, tag["Key"]), seen).otherwise(
            F.map_concat(seen, F.create_map(tag["Key"], tag["Value"]))
        ),
    )


def is_tagged(tags: Column, key: str, value: str) -> Column:
    """Whether a Key/Value list has exactly this tag."""
    return F.exists(
        F.coalesce(tags, F.array().cast("array<struct<Key:string,Value:string>>")),
        lambda tag: (tag["Key"] == key) & (tag["Value"] == value),
    )


def pods_from_json(listing: DataFrame, text: str = "pod") -> DataFrame:
    """Pods in the shape `operators.health` takes, from one JSON object per row."""

    def containers(column: Column) -> Column:
        return F.transform(
            column,
            lambda c: F.struct(
                c["ready"].alias("ready"),
                c["restartCount"].alias("restart_count"),
                c["state"]["waiting"]["reason"].alias("waiting_reason"),
            ),
        )

    pod = F.from_json(F.col(text), POD)
    rest = [c for c in listing.columns if c != text]
    return listing.select(*rest, pod.alias("__pod")).select(
        *rest,
        F.col("__pod.metadata.namespace").alias("namespace"),
        F.col("__pod.metadata.name").alias("name"),
        F.col("__pod.status.phase").alias("phase"),
        F.col("__pod.status.conditions").alias("conditions"),
        containers(F.col("__pod.status.containerStatuses")).alias("containers"),
        containers(F.col("__pod.status.initContainerStatuses")).alias("inits"),
    )


def routes_of(tables: DataFrame, table: str = "table") -> DataFrame:
    """One row per route of nested route tables, with its position."""
    return tables.select(
        F.col(f"{table}.RouteTableId").alias("table_id"),
        F.col(f"{table}.VpcId").alias("vpc_id"),
        F.posexplode(f"{table}.Routes").alias("position", "route"),
    ).select(
        "table_id",
        "vpc_id",
        "position",
        F.col("route.DestinationCidrBlock").alias("destination"),
        F.col("route.State").alias("state"),
        F.col("route.NatGatewayId").alias("nat_gateway_id"),
        F.col("route.TransitGatewayId").alias("transit_gateway_id"),
        F.col("route.VpcEndpointId").alias("vpc_endpoint_id"),
        F.col("route.NetworkInterfaceId").alias("network_interface_id"),
        F.col("route.InstanceId").alias("instance_id"),
        F.col("route.CoreNetworkArn").alias("core_network_arn"),
        F.col("route.GatewayId").alias("gateway_id"),
        F.col("route.VpcPeeringConnectionId").alias("peering_id"),
    )


def associations_of(tables: DataFrame, table: str = "table") -> DataFrame:
    """One row per association of nested route tables."""
    return tables.select(
        F.col(f"{table}.RouteTableId").alias("table_id"),
        F.col(f"{table}.VpcId").alias("vpc_id"),
        F.explode(f"{table}.Associations").alias("a"),
    ).select(
        "table_id",
        "vpc_id",
        F.col("a.SubnetId").alias("subnet_id"),
        F.coalesce(F.col("a.Main"), F.lit(False)).alias("main"),
    )


def blocks_of(vpcs: DataFrame, vpc: str = "vpc") -> DataFrame:
    """One row per block a network carries, with its state, in listing order."""
    from ..functions.cidr import parse_cidr

    return vpcs.select(
        F.col(f"{vpc}.VpcId").alias("vpc_id"),
        F.posexplode(f"{vpc}.CidrBlockAssociationSet").alias("position", "a"),
    ).select(
        "vpc_id",
        "position",
        F.col("a.CidrBlockState.State").alias("state"),
        parse_cidr(F.col("a.CidrBlock")).alias("net"),
    )


def resources_of(exports: DataFrame, export: str = "export") -> DataFrame:
    """One row per resource of stack-state exports (JSON text), with the stack's columns."""
    rest = [c for c in exports.columns if c != export]
    state = F.from_json(F.col(export), STATE_EXPORT)
    return exports.select(*rest, F.explode(state["deployment"]["resources"]).alias("r")).select(
        *rest,
        F.col("r.type").alias("type"),
        F.col("r.urn").alias("urn"),
        F.col("r.outputs.vpcId").alias("vpc_id"),
    )
