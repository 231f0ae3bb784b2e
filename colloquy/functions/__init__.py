"""colloquy.functions"""
