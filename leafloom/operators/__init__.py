"""leafloom.operators"""
