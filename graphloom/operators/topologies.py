"""Fixed network topologies, both directions of every link; nodes are names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .graph import symmetrise

# The links of four networks, each link once.
_DTELEKOM = """
Node67-Node52 Node67-Node04 Node66-Node05 Node66-Node04 Node65-Node62 Node65-Node04 Node65-Node26 Node64-Node04 Node64-Node23 Node63-Node45
Node63-Node51 Node62-Node23 Node62-Node28 Node61-Node05 Node61-Node04 Node61-Node23 Node61-Node45 Node60-Node03 Node60-Node04 Node60-Node05
Node60-Node17 Node59-Node38 Node59-Node37 Node59-Node47 Node59-Node42 Node59-Node58 Node59-Node45 Node59-Node40 Node59-Node23 Node59-Node28
Node59-Node27 Node59-Node09 Node58-Node45 Node58-Node05 Node58-Node04 Node58-Node03 Node58-Node01 Node57-Node05 Node57-Node04 Node57-Node02
Node56-Node23 Node56-Node09 Node56-Node06 Node56-Node05 Node56-Node04 Node56-Node03 Node56-Node01 Node55-Node40 Node55-Node09 Node55-Node08
Node55-Node06 Node55-Node05 Node55-Node03 Node55-Node01 Node54-Node42 Node54-Node06 Node54-Node05 Node54-Node04 Node54-Node03 Node54-Node01
Node53-Node51 Node53-Node45 Node53-Node23 Node53-Node09 Node53-Node05 Node52-Node09 Node52-Node05 Node52-Node04 Node52-Node03 Node52-Node01
Node51-Node48 Node51-Node45 Node51-Node27 Node51-Node23 Node51-Node05 Node50-Node05 Node50-Node04 Node50-Node03 Node50-Node02 Node50-Node01
Node49-Node23 Node49-Node05 Node49-Node04 Node49-Node03 Node49-Node01 Node48-Node05 Node48-Node04 Node48-Node03 Node48-Node01 Node47-Node06
Node47-Node01 Node46-Node40 Node46-Node05 Node45-Node48 Node45-Node04 Node45-Node03 Node45-Node01 Node44-Node06 Node44-Node04 Node44-Node03
Node44-Node02 Node44-Node01 Node43-Node26 Node43-Node10 Node43-Node06 Node43-Node05 Node43-Node04 Node43-Node01 Node42-Node40 Node42-Node05
Node42-Node04 Node42-Node03 Node42-Node01 Node41-Node31 Node41-Node05 Node41-Node04 Node41-Node03 Node41-Node01 Node40-Node23 Node40-Node09
Node40-Node08 Node40-Node04 Node40-Node03 Node40-Node01 Node39-Node19 Node39-Node17 Node39-Node06 Node39-Node01 Node38-Node23 Node38-Node06
Node38-Node05 Node38-Node04 Node38-Node01 Node37-Node23 Node36-Node06 Node36-Node05 Node36-Node03 Node36-Node01 Node35-Node05 Node35-Node04
Node35-Node03 Node35-Node01 Node34-Node26 Node34-Node23 Node34-Node05 Node34-Node04 Node34-Node01 Node33-Node23 Node33-Node18 Node33-Node15
Node33-Node09 Node33-Node03 Node32-Node06 Node32-Node05 Node32-Node04 Node32-Node03 Node32-Node02 Node32-Node01 Node31-Node04 Node31-Node03
Node30-Node06 Node30-Node05 Node30-Node04 Node30-Node03 Node30-Node01 Node29-Node26 Node29-Node06 Node29-Node05 Node29-Node04 Node29-Node03
Node29-Node01 Node28-Node06 Node28-Node05 Node28-Node04 Node28-Node03 Node28-Node01 Node27-Node05 Node27-Node03 Node26-Node12 Node26-Node06
Node26-Node05 Node26-Node02 Node25-Node06 Node25-Node05 Node25-Node01 Node24-Node23 Node24-Node06 Node24-Node05 Node24-Node04 Node24-Node03
Node24-Node01 Node23-Node06 Node23-Node05 Node22-Node06 Node22-Node05 Node21-Node06 Node21-Node05 Node21-Node04 Node21-Node03 Node21-Node01
Node20-Node06 Node20-Node05 Node20-Node04 Node20-Node03 Node20-Node02 Node20-Node01 Node19-Node17 Node19-Node06 Node19-Node05 Node18-Node04
Node18-Node03 Node18-Node01 Node17-Node01 Node16-Node05 Node16-Node04 Node16-Node03 Node16-Node01 Node15-Node11 Node15-Node09 Node15-Node06
Node15-Node05 Node15-Node04 Node14-Node04 Node14-Node03 Node14-Node01 Node13-Node06 Node13-Node04 Node13-Node03 Node13-Node02 Node12-Node05
Node12-Node04 Node11-Node06 Node11-Node05 Node11-Node04 Node11-Node02 Node11-Node01 Node10-Node06 Node10-Node04 Node10-Node03 Node10-Node01
Node09-Node06 Node09-Node05 Node09-Node04 Node09-Node03 Node09-Node01 Node08-Node06 Node08-Node04 Node08-Node03 Node07-Node06 Node07-Node05
Node07-Node04 Node07-Node03 Node07-Node01 Node06-Node05 Node06-Node04 Node06-Node03 Node06-Node01 Node05-Node04 Node05-Node03 Node05-Node02
Node05-Node01 Node04-Node03 Node04-Node02 Node04-Node01 Node03-Node02 Node03-Node01 Node02-Node01 Node00-Node01 Node00-Node02 Node00-Node03
Node00-Node04 Node00-Node05 Node00-Node06
"""
_ABILENE = """
NEWY-WASH NEWY-CHIC CHIC-WASH ATLA-WASH ATLA-CHIC ATLA-HOUS KANS-CHIC KANS-HOUS KANS-SALT LOSA-HOUS LOSA-SALT LOSA-SEAT SALT-SEAT
"""
_SERVICENETWORK = """
CHAIN1-CHAIN2 CHAIN3-CHAIN2 CHAIN3-CHAIN4 CHAIN4-CONSUMER1 CHAIN4-CONSUMER2 CHAIN4-CONSUMER3 CHAIN4-CONSUMER4
"""
_GEANT = """
node0-node1 node0-nodeL node1-node2 node1-node3 node1-nodeF node2-node3 node3-nodeC node3-node4 node4-nodeL node4-nodeI node4-node7 node5-node6
node5-nodeE node6-node7 node7-node8 node8-node9 node9-nodeA node9-nodeC nodeA-nodeB nodeB-nodeC nodeC-nodeD nodeC-nodeF nodeD-nodeE nodeE-nodeF
nodeE-nodeG nodeE-nodeL nodeF-nodeH nodeG-nodeH nodeH-nodeI nodeI-nodeJ nodeI-nodeK nodeJ-nodeK nodeK-nodeL
"""


def _links(spark: SparkSession, text: str) -> DataFrame:
    pairs = [tuple(link.split("-")) for link in text.split()]
    return symmetrise(spark.createDataFrame(pairs, "src string, dst string"))


def dtelekom(spark: SparkSession) -> DataFrame:
    return _links(spark, _DTELEKOM)


def abilene(spark: SparkSession) -> DataFrame:
    return _links(spark, _ABILENE)


def servicenetwork(spark: SparkSession) -> DataFrame:
    return _links(spark, _SERVICENETWORK)


def geant(spark: SparkSession) -> DataFrame:
    return _links(spark, _GEANT)
