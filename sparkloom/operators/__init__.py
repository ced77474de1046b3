"""sparkloom.operators"""
